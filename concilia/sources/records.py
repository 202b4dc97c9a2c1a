"""Records of delimited text that span lines.

A line break inside quotes, or behind an escape character, does not end a
record. Where a line begins (at a record's start, in quotes, or inside an
unquoted field) follows from all text before it; but a line only maps each of
these three states to one of them, and such maps compose. So a file is never
read in one task:

1. the lines that hold a quote or end with an escape, and no others, give
   every file block its map (one narrow row per block);
2. the maps of a file's blocks, in order, give the state in which each block
   begins;
3. blocks in which every line is a record pass as they are; the lines of the
   others are joined block by block, and the pieces of a record that a block
   border cuts (at most two per block) are put together.

A record of more than ``FIELD_LIMIT`` characters in several lines is no record
but a quote that nothing closes: its lines are taken one by one, so no task
holds more of a file than that. Quotes and escapes count as the standard
library's ``csv`` module reads them: a quote opens a quoted field only at a
field's start, ``""`` inside is a quote, an escape makes the next character
plain, in quotes and outside.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, on_workers

QUOTE, ESCAPE = '"', "\\"
#: Longest field that the csv module reads.
FIELD_LIMIT = 131_072
#: Where a line begins: at a record's start, in quotes, inside an unquoted field.
START, QUOTED, INSIDE = 0, 1, 2

_TOKEN = re.compile(r'[^",\\]+|\\.|\\|"|,', re.S)
# from: field start, in quotes, inside a field, behind a quote in quotes
_STEP = {'"': (1, 3, 2, 1), ",": (0, 1, 0, 0)}
_PLAIN = (2, 1, 2, 2)


def has_mark(line: Column) -> Column:
    """Lines that can begin or end a record other than at their ends."""
    return line.contains(QUOTE) | line.endswith(ESCAPE)


def behind(line: str, sep: str = ",") -> tuple[int, int, int]:
    """The state behind a line for each of the states in which it can begin."""
    if QUOTE not in line and not line.endswith(ESCAPE):
        return START, QUOTED, START
    now, escaped = (0, 1, 2), False
    for m in _TOKEN.finditer(line if sep == "," else line.replace(",", " ").replace(sep, ",")):
        token = m[0]
        step = _STEP.get(token, _PLAIN)
        now = tuple(step[s] for s in now)
        escaped = token == ESCAPE
    return tuple(QUOTED if s == 1 else INSIDE if escaped else START for s in now)


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(ddl: str):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(ddl)])


def block_maps(lines: DataFrame, sep: str = ",") -> DataFrame:
    """Per file block, from its marked lines alone: where the first and the
    last of them are, the state behind them for each state before, and whether,
    from a record's start, a record goes on behind one of them. A scan hands a
    block's lines on in order, so nothing is shuffled."""
    schema = "path string, block bigint, mark0 bigint, mark1 bigint, to0 int, to1 int, to2 int, open boolean"
    arrow = _arrow(schema)

    def run(batches):
        here, out = None, []
        for b in batches:
            for path, block, at, line in zip(*(c.to_pylist() for c in b.columns)):
                if here is None or here[:2] != [path, block]:
                    if here:
                        out.append((*here[:4], *here[4], here[5]))
                    here = [path, block, at, at, (START, QUOTED, INSIDE), False]
                now = here[4]
                if at > here[3] + 1:  # unmarked lines lie between
                    now = tuple(QUOTED if s == QUOTED else START for s in now)
                step = behind(line, sep)
                here[3], here[4] = at, tuple(step[s] for s in now)
                here[5] = here[5] or here[4][START] != START
        if here:
            out.append((*here[:4], *here[4], here[5]))
            yield _batch(out, arrow)

    return on_workers(lines.filter(has_mark(F.col("line"))).select("path", "block", "at", "line"), run, schema)


def block_states(blocks: DataFrame, maps: DataFrame) -> DataFrame:
    """(path, block, state): the blocks that do not consist of whole one-line
    records, with the state in which they begin. ``blocks``: (path, block,
    first, last: where its first and last lines are) of all blocks; one
    narrow row each, a file's rows pass one task in order."""
    schema = "path string, block bigint, state int"
    arrow = _arrow(schema)
    known = blocks.select("path", "block", "first", "last").join(maps, ["path", "block"], "left")

    def run(batches):
        file, state = None, START
        for b in batches:
            out = []
            for path, block, first, last, mark0, mark1, *to, opened in zip(*(c.to_pylist() for c in b.columns)):
                if path != file:
                    file, state = path, START
                if mark0 is None:
                    dirty, end = state != START, QUOTED if state == QUOTED else START
                else:
                    begin = START if state == INSIDE and first < mark0 else state
                    dirty, end = state != START or opened, to[begin]
                    if end == INSIDE and mark1 < last:
                        end = START
                if dirty:
                    out.append((path, block, state))
                state = end
            if out:
                yield _batch(out, arrow)

    return on_workers(known.repartition("path").sortWithinPartitions("path", "block"), run, schema)


def joined_lines(lines: DataFrame, states: DataFrame, sep: str = ",", limit: int = FIELD_LIMIT) -> DataFrame:
    """(path, block, nth, head, tail, over, lines): the records of the blocks
    in ``states`` in order; head and tail: pieces that go on before or behind
    the block; over: longer than ``limit``, its lines follow one by one."""
    schema = "path string, block bigint, nth bigint, head boolean, tail boolean, over boolean, lines array<string>"
    arrow = _arrow(schema)
    theirs = lines.select("path", "block", "at", "line").join(states, ["path", "block"])

    def run(batches):
        here, state, nth, held, size, head, over, out = None, START, 0, [], 0, False, False, []

        def give(tail: bool):
            nonlocal nth, held, size, head, over
            if held or over or head:
                out.append((*here, nth, head, tail, over, held))
                nth += 1
            held, size, head, over = [], 0, False, False

        def singly():
            nonlocal nth, held, size
            for x in held:
                out.append((*here, nth, False, False, False, [x]))
                nth += 1
            held, size = [], 0

        for b in batches:
            for path, block, _, line, begin in zip(*(c.to_pylist() for c in b.columns)):
                if here != (path, block):
                    if here:
                        give(True)
                    here, state, nth, head = (path, block), begin, 0, begin != START
                held.append(line)
                size += len(line) + 1
                state = behind(line, sep)[state]
                if over or (size > limit and (head or state != START or len(held) > 1)):
                    over = True
                    singly()
                if state == START:
                    give(False)
                if len(out) >= 4096:
                    yield _batch(out, arrow)
                    out.clear()
        if here:
            give(state != START)
        if out:
            yield _batch(out, arrow)

    dealt = theirs.repartition("path", "block").sortWithinPartitions("path", "block", "at")
    return on_workers(dealt.select("path", "block", "at", "line", "state"), run, schema)


def records(lines: DataFrame, blocks: DataFrame, sep: str = ",", limit: int = FIELD_LIMIT) -> DataFrame:
    """(path, lines: array of string): one row per record of ``lines`` (path,
    block, at, line; at: ascending in a block). ``blocks``: (path, block,
    first, last, marked) of all blocks, marked: some line ``has_mark``."""
    alone = lines.select("path", F.array("line").alias("lines"))
    if blocks.filter("marked").isEmpty():
        return alone
    states = cut_lineage(block_states(blocks, block_maps(lines, sep)))
    if states.isEmpty():
        return alone
    whole = lines.join(states, ["path", "block"], "left_anti").select("path", F.array("line").alias("lines"))
    parts = cut_lineage(joined_lines(lines, states, sep, limit))
    inner = parts.filter("NOT head AND NOT tail AND NOT over")
    # pieces at block borders: a chain begins with a piece that has no head; chains are numbered on narrow rows
    cut = parts.filter("head OR tail OR over")
    w = Window.partitionBy("path").orderBy("block", "nth")
    chain = cut.select("path", "block", "nth", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(w).alias("chain"))
    pieces = cut.join(chain, ["path", "block", "nth"])
    size = F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(x) + 1)
    chains = pieces.groupBy("path", "chain").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "lines"))), lambda p: p["lines"])).alias("lines"),
        F.max("over").alias("over"), F.sum(size).alias("size"))
    long = F.col("over") | (F.col("size") > limit)
    singles = chains.filter(long).select("path", F.explode("lines").alias("x")).select("path", F.array("x").alias("lines"))
    together = chains.filter(~long & (F.size("lines") > 0)).select("path", "lines")
    return whole.unionByName(inner.select("path", "lines")).unionByName(together).unionByName(singles)


def parsed(text: Column, n: int, sep: str = ",", strict: bool = False) -> Column:
    """The ``n`` fields of a record with quotes and escapes, or NULL if it has
    another number of fields, or a quote that nothing closes; ``strict``: also
    if a field goes on behind the quote that closes it."""
    c = "\\" + sep if sep in "|.*+?()[]{}^$\\" else sep
    part = r'[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+'
    rest = rf"[^{c}\\]*+(?:\\.[^{c}\\]*+)*+\\?+"
    raw = F.regexp_extract_all(F.concat(F.lit(sep), text), F.lit(rf'(?s)\G{c}("{part}"{"" if strict else rest}|(?!"){rest})'), F.lit(1))
    plain = lambda x: F.regexp_replace(x, r"(?s)\\(.)", "$1")
    within = lambda x: F.regexp_replace(x, r'(?s)\\(.)|"(")', "$1$2")
    quoted = rf'(?s)^"({part})"(.*)$'
    fields = F.transform(raw, lambda f: F.when(
        f.startswith(QUOTE), F.concat(within(F.regexp_extract(f, quoted, 1)), plain(F.regexp_extract(f, quoted, 2)))).otherwise(plain(f)))
    covered = F.aggregate(raw, F.lit(0), lambda k, f: k + F.length(f) + F.lit(len(sep))) == F.length(text) + F.lit(len(sep))
    return F.when(covered & (F.size(raw) == n), fields)
