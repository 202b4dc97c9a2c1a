"""The training-data operators against brute force on small tables that hold
nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from concilia.llm import (byte_bpe, chat, exact_dedup, html_extract, mixing, near_dup, quality, secret_scan, token_counts,
                          token_store)
from concilia.llm.common import scratch_path, stored

WS = re.compile(r"[\x20\x09-\x0D]+")


def _texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(120)
    near = []
    for k in range(6):
        w = base.split()
        w[10 + k] = "changed"
        near.append(" ".join(w))
    return [None, "", " \t\n", "one", "one ", "O ne", "two words", base, base, base + "\n", *near, say(3000), "x" * 30000,
            "a  b ", "\n\r\x0b", "é中\U0001F600 ▁<s>", "token: token: abcdef", say(50), say(60)]


SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, n long, node string"


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    out = [(i, t, "en" if i % 5 else None, f"s{i % 3}" if i % 7 else None, None, 1, "x") for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[WS.sub("", t or "")].append((-len(t or ""), i))
    want = {(i, min(m)[1], len(m), i == min(m)[1], hashlib.sha256(k.encode()).hexdigest())
            for k, m in groups.items() for _, i in m}
    assert {tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()} == want
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[3]}
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_dedup_survives_hash_collisions(docs, rows):
    from pyspark.sql import functions as F

    weak = exact_dedup.exact_duplicates(docs, content_hash=lambda c: F.substring(F.md5(c), 1, 1))
    assert {tuple(r) for r in weak.collect()} == {tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()}


def _overlapping():
    """Repeated and null ids: equal rows, other texts under one id, rejected and copied ones beside kept ones."""
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    a, b, c, d, e = (say(90) for _ in range(5))
    near = " ".join(["changed", *c.split()[1:]])
    rows = [(1, a), (1, a), (1, "too short"), (2, b), (1, b + " "), (None, c), (None, "short"), (None, c), (3, near), (3, d),
            (4, d), (4, d + "\n"), (5, e), (5, e), (5, near), (None, None)]
    return [(i, t, "en", "s", str(n)) for n, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("as_file", [False, True])
def test_filters_decide_by_row(spark, as_file):
    rows = _overlapping()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n string").coalesce(1)
    docs = stored(docs, "test-rows") if as_file else docs
    good = {r[4] for r in rows if len((r[1] or "").split()) >= 10}
    assert {r.n for r in quality.drop_rejected(docs).collect()} == good

    groups = defaultdict(list)
    for i, t, _, _, n in rows:
        groups[WS.sub("", t or "")].append((-len(t or ""), i is None, i or 0, int(n)))
    kept = {str(min(g)[3]) for g in groups.values()}
    assert sorted(r.n for r in exact_dedup.drop_exact_duplicates(docs).collect()) == sorted(kept)
    verdicts = exact_dedup.exact_duplicates(docs).collect()
    assert len(verdicts) == len(rows) and sum(r.kept for r in verdicts) == len(kept)

    by_row = [(int(n), t) for _, t, _, _, n in rows]
    comps = defaultdict(list)
    for n, (_, root) in _components(by_row, 5, 80).items():
        comps[root].append((rows[n][0] is None, rows[n][0] or 0, n))
    got = near_dup.drop_near_duplicates(docs).collect()
    assert sorted(r.n for r in got) == sorted(str(min(g)[2]) for g in comps.values())
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n"}


def _shingles(t, size):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def _components(rows, size, percent):
    sets = {r[0]: _shingles(r[1], size) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("options", [{}, {"leaf": 2, "branch": 3, "depth": 2}])
def test_near_duplicates(docs, rows, options):
    got = near_dup.similar_components(docs, 3, 85, **options).collect()
    want = _components(rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_empty(empty):
    assert near_dup.similar_components(empty, 3, 85).count() == 0


def _together(spark, branch, percent, levels, pairs=600):
    """Share of threshold pairs (nodes 2k, 2k + 1) that start in one bucket and still share one some levels down."""
    rng = np.random.default_rng(11)
    one = rng.integers(0, 1 << 16, (pairs, near_dup.WIDTH), np.uint16)
    two = np.where(rng.random(one.shape) < percent / 100, one, rng.integers(0, 1 << 16, one.shape, np.uint16))
    sig = {2 * k + x: t[k].tobytes() for x, t in enumerate((one, two)) for k in range(pairs)}
    rows = [(7, n) for n in sig]
    for level in range(levels):
        df = spark.createDataFrame([(k, n, sig[n]) for k, n in rows], "key long, node long, sig binary")
        got = {(r.key, r.node) for r in branch(df, percent, level).collect()}
        rows = [(k, n) for k, n in got if (k, n ^ 1) in got]
    return len({n // 2 for _, n in rows}) / pairs


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_pairs_survive_branching(spark, percent):
    branch = lambda df, percent, level: near_dup._branch(df, percent, level == 0)
    assert _together(spark, branch, percent, 10) >= 0.95


def test_near_duplicates_number_of_trees():
    for percent in (30, 80, 85, 100):
        found = (percent / 100) ** near_dup.BASE * near_dup.survival(percent)
        assert near_dup.survival(percent) > 0.5 and (1 - found) ** near_dup.number_of_trees(percent) <= 1 - near_dup.RECALL


def test_token_counts(docs, rows, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in rows}
    for chunk, overlap in ((16384, 512), (50, 2)):
        got = token_counts.count_tokens(docs, path, chunk=chunk, overlap=overlap).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode_texts(docs, path, P.PATTERN)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t, *_ in rows}
    back = byte_bpe.decode_ids(encoded, path, P.PATTERN)
    assert {r.doc_id: bytes(r.text_bytes).decode() for r in back.collect()} == {i: t or "" for i, t, *_ in rows}
    assert byte_bpe.round_trip(empty, path, P.PATTERN).count() == 0


def test_token_store(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    root = scratch_path(spark, "test")
    token_store.write_tokens(docs, root, path, end_id=2)
    got = {r.doc_id: r for r in token_store.read_tokens(spark, root).collect()}
    start = 0
    for i, t, *_ in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        raw = np.asarray(ids, "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids), got[i].ids_crc32) == (start, len(ids), raw, zlib.crc32(raw))
        start += len(ids)
    assert token_store.read_document(spark, root, 7) == [tk.encode(rows[7][1], add_special_tokens=False).ids + [2]]


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    weak = "aB3" + "x" * 37
    texts = [None, "", "token: token: abcdef", "Password = 'secret12' and " + "0123456789abcdef" * 2, key, weak,
             f"{key} {weak} https://a.example.com/x", f"{weak} " + "y " * 400 + key, "token=abc", "token=abcdef " * 500]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, kind long")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    assign = re.compile(secret_scan.BASE[0][1][4:], re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        base = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
    assert got[5].spans == "" and "secret" not in got[7].spans  # a weak candidate alone, or too far away
    assert got[6].spans == "access:0:20,secret:21:61,endpoint:62:85"


def test_secrets_of_any_length(spark):
    long = "aB3" + "xY+/" * 21
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    texts = [f"{key} {long[:86]}== https://a.example.com/x", f"{'aB3' * 40} https://a.example.com/x", f"{long[:86]}=="]
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "access:0:20,secret:21:109,endpoint:110:133", 1: "secret:0:120", 2: ""}


def test_quality(docs, rows, empty):
    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i:i + 5])].append(i)
        inside = {i + k for m in at.values() if len(m) > 1 for i in m for k in range(5)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)

    for t in ["a b c d e f g a b c d e", "l 1\nl 1\n\n\nl 1", "x " * 50, "#a |b|\x0bc", *[r[1] for r in rows]]:
        assert quality.text_counts(t or "")[:5] == brute(t)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t, *_ in rows:
        n, chars, symbols, dup, repeat = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n) and (not r.kept or not r.base_failed)
    assert quality.judge(empty).count() == 0


def test_quality_outliers(spark):
    rng = random.Random(3)
    words = ["the", "of", "house", "winter", "running", "a", "green", "river", "to", "stone", "because", "sun"]
    clean = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(40, 200))) for _ in range(300)]
    junk = [" ".join(rng.choice(words).upper() + "!! ###" for _ in range(80)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)],
                                 "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].kept or got[i].base_failed for i in range(300)) and not any(got[i].kept for i in range(300, 330))


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs, block_rows=2, resolution=40).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    assert len({(r.slot, r.block_row) for r in got}) == len(got)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns and mixing.mixed_rows(docs).count() == len(rows)
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"s0": 1.0}).count()


def test_mixing_deviates_by_less_than_a_block(spark):
    many = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    weights = {"hot": 0.43, **{f"s{i}": 0.05 + 0.011 * i for i in range(7)}}
    got = mixing.mix(many, weights=weights, block_rows=5, resolution=100).collect()
    slots, last = defaultdict(list), defaultdict(int)
    for r in got:
        last[r.source] = max(last[r.source], r.block + 1)
        if r.block_row == 0:
            slots[r.source].append(r.slot)
    total = sum(weights.values())
    k = {s: max(1, round(w / total * 100)) for s, w in weights.items()}
    q = sum(k.values())
    taken = sorted(x for m in slots.values() for x in m)
    assert len(set(taken)) == len(taken)
    for s, m in slots.items():
        m.sort()
        for t in range(0, m[-1] + 1):
            had = np.searchsorted(m, t)
            assert abs(had - min(k[s] * t / q, last[s])) < 1


@pytest.mark.parametrize("n", [3000, 5000])
def test_mixing_reaches_the_target_weights_of_many_sources(spark, n):
    many = spark.range(2000 + n).selectExpr("id AS doc_id", "IF(id < 2000, 'hot', concat('s', id)) AS source")
    weights = {"hot": 0.5, **{f"s{i}": 0.5 / n for i in range(2000, 2000 + n)}}
    got = mixing.mix(many, weights=weights, block_rows=1).collect()
    assert len(got) == len({r.slot for r in got}) == 2000 + n
    hot = sorted(r.slot for r in got if r.source == "hot")
    assert all(abs(np.searchsorted(hot, t) - 0.5 * t) < 1 for t in range(hot[-1] + 1))
    assert all(0 <= r.slot < 2 * n for r in got if r.source != "hot")


def test_mixing_quotas_are_near_the_target_weights():
    rng = random.Random(8)
    for sizes in ({"a": 100, "b": 900_000_000, **{f"s{i}": 100 for i in range(3000)}}, {f"s{i}": rng.randint(1, 10**9) for i in range(6000)}):
        k, w = mixing.quotas(sizes), {s: n ** 0.5 for s, n in sizes.items()}
        q, total = sum(k.values()), sum(w.values())
        assert all(abs(k[s] / q / (w[s] / total) - 1) <= mixing.TOLERANCE for s in sizes)
    k = mixing.quotas({"a": 1, "b": 1}, {"a": 0.0001, "b": 0.9999})
    assert k == {"a": 1, "b": 9999}


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    data = [(1, 0, "system", "s"), (1, 1, "user", "<turn>\\l"), (1, 2, "assistant", said), (1, 3, None, None),
            (1, 4, "assistant", ""), (1, 4, "assistant", "b\\"), (None, 0, "assistant", "x"), (2, 0, "user", "q")]
    convs = chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(chat.read_back(convs)).collect()}
    groups = defaultdict(list)
    for c, t, r, x in data:
        groups[c].append((t, r or "", x or ""))
    for c, m in groups.items():
        m.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in m)
        loss = "".join(x for _, r, x in m if r == "assistant")
        assert got[c].n_turns == len(m) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    full = {(r.conv_id, r.example): r for r in chat.materialised(convs).collect()}
    formatted = {r.conv_id: r.formatted for r in convs.collect()}
    assert len(full) == 4 and all(formatted[c].startswith(r.context + r.target) for (c, _), r in full.items())


def test_html(spark):
    page = ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav>'
            '<div class="ad">Buy now, it is a very good thing to buy.</div><article><h1>A &amp; B</h1><p>First <b>text\n one.<br>'
            '<p>Second &lt;x&gt; &am<div class="comments"><p>A reader says this here.</div></article><footer>&copy; x</footer>')
    assert html_extract.extract(page) == "A & B\nFirst text one.\nSecond <x> &am"
    assert html_extract.extract("") == "" and html_extract.extract("<!-- x") == ""
    many = "<article>" + "<p>some words here.</p>" * 3000 + "</article>"
    assert html_extract.extract(many).count("\n") == 2999
    pages = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5)], "page_id long, url string, html string, text long")
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    assert got[1].n_chars == len(got[1].text) and (got[2].text, got[2].n_chars) == ("", 0)


@pytest.mark.parametrize("around", [
    '<div class="content with-sidebar">{}</div>', '<div id="main-search"><article>{}</article></div>',
    '<div class="post no-comments">{}</div>', '<form id="aspnetForm"><div class="content">{}</div></form>', "<form>{}</form>",
    '<article data-title="The hidden valley">{}</article>', '<article data-id="comment">{}</article>',
    '<div class="widget"><article class="post category-ads">{}</article></div>', '<aside><main>{}</main></aside>',
    '<div class="sidebar-page-container"><div itemprop="articleBody">{}</div></div>'])
def test_html_keeps_articles_under_wrappers(around):
    text = ["The valley lies between two mountains and is known for its rivers, its old bridges and its long winters.",
            "People have lived there for many hundred years, and most of them worked in the woods or on small farms."]
    page = ('<body><nav><a href="/">Home</a></nav>' + around.format("".join(f"<p>{t}</p>" for t in text))
            + '<div class="comments"><article><p>I was there last year and liked it a lot.</p></article></div>'
            '<div hidden><p>This text is not displayed at all, however long it may be, and so it is no text.</p></div>'
            '<footer><p>All rights reserved.</p></footer></body>')
    assert html_extract.extract(page) == "\n".join(text)


def test_html_neighbours_overrule_a_mark():
    said = "This long paragraph of the article has a class that looks like a mark of boilerplate, but it is none."
    page = f'<div><p>{said}</p><p class="notice">{said}</p><p>{said}</p></div>'
    assert html_extract.extract(page).count("\n") == 2


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda x: sum(abs(s) for s, k in zip(scores, x) if (s > 0) != k) + sum(w for i, j, w in edges if x[i] != x[j])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.min_cut(scores, edges)) - best) < 1e-6


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    good = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    last = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert last <= good <= ids and last


def test_pipeline_returns_the_mixture_order(spark):
    import corpus_pipeline

    many = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', CAST(3000 - id AS INT) % 97) AS text", "'en' AS lang",
                                        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = stored(corpus_pipeline.mix(spark, many, ""), "test-mix")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(mixed.inputFiles()) > 1
    got = sorted(corpus_pipeline.encode(spark, mixed, "").collect(), key=lambda r: r.position)
    want = sorted(mixing.mix(many).collect(), key=lambda r: (r.slot, r.block_row))
    assert [r.position for r in got] == list(range(3000)) and [r.doc_id for r in got] == [r.doc_id for r in want]


def test_pipeline_returns_token_ids(spark, docs, rows):
    import corpus_pipeline

    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, stored(docs.select("doc_id", "text"), "test-encode"), "").collect()}
    codec = byte_bpe.codec(path, P.PATTERN)
    for i, t, *_ in rows:
        ids = codec.encode([t or ""])[0]
        r = got[i]
        assert (bytes(r.ids), r.n_tokens, r.ids_sha256) == (ids, len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    rows = [(i, t, lang, f"s{int(n) % 2}", n) for i, t, lang, _, n in _overlapping()]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n string").coalesce(1), "test-docs")
    last = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, last = last, stored(stage(spark, last, ""), f"test-{name}")
    got = corpus_pipeline.STAGES[-1][1](spark, last, "").collect()

    order = lambda r: (r[0] is None, r[0] or 0, int(r[4]))
    left = [r for r in rows if len((r[1] or "").split()) >= 10]
    groups = defaultdict(list)
    for r in left:
        groups[WS.sub("", r[1] or "")].append(r)
    left = [min(g, key=lambda r: (-len(r[1]), order(r))) for g in groups.values()]
    roots = _components([(int(r[4]), r[1]) for r in left], 5, 80)
    comps = defaultdict(list)
    for r in left:
        comps[roots[int(r[4])][1]].append(r)
    want = [min(g, key=order) for g in comps.values()]
    assert 0 < len(want) < len(left) < len(rows)
    assert sorted(map(tuple, before.collect()), key=order) == sorted(map(tuple, last.collect()), key=order) == sorted(want, key=order)
    codec = byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert sorted(bytes(r.ids) for r in got) == sorted(codec.encode([r[1] for r in want]))
    mixed = sorted(mixing.mix(before).collect(), key=lambda r: (r.slot, r.block_row))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == [r.doc_id for r in mixed]
