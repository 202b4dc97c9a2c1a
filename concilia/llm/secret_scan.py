"""Secret scan with multipart credential linking.

Base findings, leftmost and non-overlapping per kind:

* ``assign``  a keyword assignment whose value has 6 or more characters
* ``access``  an access identifier, ``AKIA...`` of 20 or more characters
* ``hex``     a run of 24 or more lower-case hex digits

Credentials come in parts: an access identifier, a secret and an endpoint
near each other. Two weak kinds are searched as well, ``secret`` (a bare
token of 40 or more base64 characters, with its padding, that has an
upper-case letter, a lower-case letter and a digit) and ``endpoint`` (a URL). Alone they are no
finding; they are reported only when complementary parts lie within
``scope`` code points:

* a weak secret needs an identifier (``access``) or an endpoint in scope
* an endpoint needs an identifier and a secret (``assign``, ``hex`` or a
  weak ``secret``) in scope

The interval join of the parts is a RANGE window over their positions
within the document, so no pair of parts is ever formed and a document
full of secrets costs as much as its findings. Base findings always stay.

A position is the sum of the lengths of the pieces between the matches and
of the matches before it: ``split`` and ``regexp_extract_all`` with one
pattern give both lists. Texts without a match of a kind skip them.

Null text is empty; null or repeated ids keep one result row per input
row (rows are tracked by a row number of the scan); an empty table gives no
rows; other columns are
ignored. All of it is Spark SQL; the only shuffle carries the findings and
one small row per document, by row number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import body

SCOPE = 400

#: Fixed values of the contract: (kind, pattern), in the order of the kinds.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]{24,}"),
)
WEAK = (
    ("secret", r"[A-Za-z0-9+/]{40,}={0,2}"),
    ("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+"""),
)
KINDS = tuple(k for k, _ in BASE + WEAK)


def _matches(kind: str, pattern: str):
    """array<struct<kind, nth, gap, len, ok>> of one kind; gap: code points between this match and the one before."""
    text, p = F.col("__text"), F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(2)) if kind == "assign" else found
    ok = {
        "assign": lambda m: F.length(m) >= 6,
        "access": lambda m: F.length(m) >= 20,
        "hex": lambda m: F.lit(True),
        "secret": lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]"),
        "endpoint": lambda m: F.lit(True),
    }[kind]
    rows = F.transform(
        F.arrays_zip(found.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("g")),
        lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"),
                              F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"),
                              (x["m"].isNotNull() & ok(x["v"])).alias("ok")))
    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per reported span, and one with null kind per input row
    without any: (row, id, kind, start, end, near_access, near_secret,
    near_endpoint); near_*: parts of that type within the scope."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       body(text_col).alias("__text"))
    found = rows.select("row", "id", F.explode_outer(F.concat(*[_matches(*k) for k in BASE + WEAK])).alias("s"))
    found = found.select("row", "id", "s.*")
    upto = W.partitionBy("row", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(upto)
    spans = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    # keep one bare row per document, so that documents without findings stay
    spans = spans.filter("ok OR kind IS NULL OR nth = 0")
    spans = spans.withColumn("kind", F.expr("IF(ok, kind, NULL)"))
    near = W.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    has = lambda *kinds: F.sum(F.expr(
        f"IF(kind IN ({', '.join(str(KINDS.index(k)) for k in kinds)}), 1, 0)")).over(near)
    linked = (spans.withColumn("near_access", has("access")).withColumn("near_secret", has("assign", "hex", "secret"))
              .withColumn("near_endpoint", has("endpoint")))
    reported = F.expr(f"""kind <= {len(BASE) - 1}
        OR (kind = {KINDS.index('secret')} AND (near_access > 0 OR near_endpoint > 0))
        OR (kind = {KINDS.index('endpoint')} AND near_access > 0 AND near_secret > 0)""")
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    return linked.select("row", "id", F.when(reported, F.col("kind")).alias("nth_kind"), F.when(reported, name).alias("kind"),
                         "start", "end", "near_access", "near_secret", "near_endpoint")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per input row: id, n_assign, n_access, n_hex, base_sha256, spans."""
    spans = find_spans(docs, id_col, text_col, scope)
    label = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    one = F.struct("start", "nth_kind", label.alias("label"))
    got = spans.groupBy("row", "id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k, _ in BASE],
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("all"))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["label"]), ",")
    base = F.filter("all", lambda x: x["nth_kind"] < len(BASE))
    return got.select(F.col("id").alias(id_col), *[f"n_{k}" for k, _ in BASE],
                      F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
