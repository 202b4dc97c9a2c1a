"""Texts, ids and column names that are legal and rare, against the libraries or brute force."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from concilia.llm import byte_bpe, exact_dedup, mixing, near_dup, quality, token_counts, token_store
from concilia.llm.common import in_file_order, stored, with_row_key

WS = re.compile(r"[\x20\x09-\x0D]+")


def _texts(alphabet, n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_token_counts_beside_the_space_mark():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = _texts(["▁", " ", "  ", "a", "the", "x", ".", "\n", "é", "　", " ", "中", "<s>", "▁▁▁"], 4000, 1)
    assert token_counts.Counter(path).counts(texts) == [len(sp.encode(t)) for t in texts]
    small = token_counts.Counter(path, chunk=16, overlap=2)
    assert small.counts(texts) == [len(sp.encode(t)) for t in texts]


@pytest.mark.parametrize("unit", ["x", "▁", " ", "ab"])
def test_token_counts_are_linear_without_a_boundary(unit):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.Counter(path)
    took = []
    for n in (100_000, 400_000):
        text = unit * (n // len(unit))
        began = time.time()
        assert counter.counts([text]) == [len(sp.encode(text))]
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1


@pytest.mark.parametrize("alphabet", [
    ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", " ", "a", "B", "don't", ",", "<|", "|>", "\x01", "\n"],
    ["J", "j", "H", "T", "w", "Y", "a", "̌", "̱", "̈", "̊", "́", " ", ".", "İ", "ß", "É", "é", "K", "ſ"],
    ["The", "house", "winter", "É", "ñ", "x1", "9", "²", "½", "don't", "we'LL", "'", ".", ",", "!!", "###", "|", " ", " ", "\t", "\xa0",
     "中", "_", "×", "÷", "ª", "α", "​"]])
def test_token_store_ids_equal_the_library(alphabet):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tk, encoder = Tokenizer.from_file(path), token_store.Encoder(path)
    texts = _texts(alphabet, 5000, 2)
    assert encoder.by_part
    for i in range(0, len(texts), 500):
        got = encoder.encode(texts[i:i + 500])
        for t, ids in zip(texts[i:i + 500], got):
            assert np.frombuffer(ids, encoder.dtype).tolist() == tk.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("alphabet", [
    ["don", "'", "'s", "'T", "LL", ",", ".", "3", "é", "É", " ", "\t"],
    ["a", "E", "\u0301", "\u0338", "=", "<", "'", "12", " ", "Å", "\u20e3"],
    ["İ", "ß", "Ǆ", "ǅ", "Ⱥ", "ɏ", "ɐ", "×", "÷", "µ", "ª", "x", "-", "_", "7", " ", "\n"],
    ["Σ", "ς", "Ж", "中", "\u212b", "ﬁ", "a", ".", "9", "٣", "½", "\x00", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", " "],
    ["<|", "endoftext", "|>", "ENDOFTEXT", "<|endoftext|>", "\x01", "a", "1", ".", " "]])
def test_token_store_pieces_equal_the_library(alphabet):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tk, encoder = Tokenizer.from_file(path), token_store.Encoder(path)
    assert encoder.by_part and encoder.lean is not None
    texts = _texts(alphabet, 4000, 7, longest=12)
    for i in range(0, len(texts), 400):
        got = encoder.encode(texts[i:i + 400])
        for t, ids in zip(texts[i:i + 400], got):
            assert np.frombuffer(ids, encoder.dtype).tolist() == tk.encode(t, add_special_tokens=False).ids, t


def test_token_store_learns_pieces_not_words(monkeypatch):
    encoder, asked = token_store.Encoder(P.path("word_bpe_49k.json")), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda pieces: (asked.extend(pieces), learn(pieces)))
    words, tails = [f"{a}{b}{c}" for a in "abcd" for b in "éaou" for c in "lmnr"], [".", ",", "!!", ")"]
    texts = [f"({w}{t} {w}/{words[i - 1]}{t} {i} {i * 7919} {w}=3{t}" for i, w in enumerate(words) for t in tails]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]
    # 64 words, ten digits, and marks: not one entry per word, mark behind it and number
    assert len(asked) == len(set(asked)) <= 64 + 10 + 10 and len(encoder.memo) == len(asked)
    before = len(asked)
    encoder.encode([f"{b}!!{a}=({i}" for i, (a, b) in enumerate(zip(words, words[7:]))])
    assert asked[before:] == [b"=("]


def test_token_store_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO", 50)
    encoder = token_store.Encoder(P.path("word_bpe_49k.json"))
    texts = _texts(["ab", "c", "d.", " ", "e,", "x" * 80 + "."], 300, 5)
    plain = token_store.Encoder(P.path("word_bpe_49k.json"))
    for t in texts:
        assert encoder.encode([t]) == [plain.whole(t)]
        assert len(encoder.memo) <= 100 and all(len(w) <= 64 for w in encoder.memo)


def test_byte_bpe_in_one_pass_equals_encode_and_decode(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = list(enumerate([None, "", "x" * 3_000_000, *_texts(["a", "é", "中", " ", "don't", "\n", "123"], 500, 3)]))
    docs = spark.createDataFrame([(i, t, i * 2) for i, t in rows], "doc_id long, text string, ids long")
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs.repartition(2), path, P.PATTERN, ids=True).collect()}
    codec = byte_bpe.codec(path, P.PATTERN)
    for i, t in rows:
        ids = codec.encode([t or ""])[0]
        assert (bytes(got[i].ids), got[i].n_tokens, got[i].ids_sha256) == (ids, len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,3)"])
def test_exact_dedup_of_any_id_type(spark, kind):
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.5 else 10 + rng.randrange(60), rng.choice([" a", "a ", "b", "b b", None, "  ", f"t{rng.random()}"]))
            for _ in range(300)]
    docs = spark.createDataFrame(rows, "n int, text string")
    key = "date_add(DATE'2020-01-01', n)" if kind == "date" else f"CAST(n AS {kind})"
    docs = stored(docs.selectExpr(f"{key} AS doc_id", "n", "text", "n AS `__row`", "n AS `__len`").coalesce(1), "ids")
    groups = defaultdict(list)
    for n, t in rows:
        groups[WS.sub("", t or "")].append((-len(t or ""), n is None, n or 0))
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == 300 and sum(r.kept for r in got) == len(groups)
    for r in got:
        assert r.group_size == next(len(g) for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted(str(None if m[1] else m[2]) for m in (min(g) for g in groups.values()))
    assert sorted(str(r.n) for r in kept.collect()) == want == sorted(str(r["__row"]) for r in kept.collect())


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """No step joins rows on their ids: as many null ids as rows cost no more than distinct ones."""
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    texts = [" ".join([f"x{i}", *base.split()[1:]]) for i in range(400)] + [f"only {i} this {i * 7}" for i in range(400)]
    docs = spark.createDataFrame([(None if i % 2 else i % 10, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = near_dup.similar_components(docs, 3, 85).collect()
    assert len(got) == 800 and sum(r.component_id == 0 for r in got if r.n_shingles > 70) == 400
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 401


def test_mixing_carries_keys_and_returns_whole_rows(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('t', 200) AS text", "concat('s', id % 3) AS source", "id AS slot",
                                        "id AS `__row`", "id AS `__AT`", "-id AS block_row")
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    back = in_file_order(stored(mixed, "mixed"), "position").collect()
    order = {(r.doc_id): (r.slot, r.block_row) for r in mixing.mix(docs.select("doc_id", "source")).collect()}
    assert [r.doc_id for r in sorted(back, key=lambda r: r.position)] == sorted(order, key=order.get)
    assert all(r.slot == r.doc_id == r["__row"] == r["__AT"] == -r.block_row for r in back)


def test_the_pipeline_takes_any_column_names(spark):
    import corpus_pipeline

    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(60)), "en", "s", 7, "p", "r", "f") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids long, position string, `__row` string, `__file` string")
    last = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        last = stored(stage(spark, last, ""), f"names-{name}")
        assert last.columns == docs.columns
        assert {(r["__row"], r.position, r["__file"]) for r in last.collect()} == {("r", "p", "f")}
    got = corpus_pipeline.STAGES[-1][1](spark, last, "").collect()
    assert sorted(r.position for r in got) == list(range(len(got))) and got
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stored(stage(spark, empty, ""), f"none-{name}")
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0


def test_row_keys_do_not_hide_columns(spark):
    docs = stored(spark.range(10).selectExpr("id", "id AS `__row`"), "keys")
    from concilia.llm.common import free_name

    key = free_name(docs, "__row")
    assert key == "__row_" and with_row_key(docs, key).select(key).distinct().count() == 10


def test_empty_tables(spark):
    from concilia.llm import chat, html_extract, secret_scan
    from concilia.llm.common import scratch_path

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert secret_scan.scan_secrets(docs).count() == 0 and quality.drop_rejected(docs).count() == 0
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.digests(chat.read_back(chat.format_conversations(
        spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0
    root = scratch_path(spark, "none")
    token_store.write_tokens(docs, root, P.path("word_bpe_49k.json"), end_id=2)
    assert token_store.read_tokens(spark, root).count() == 0
    assert near_dup.drop_near_duplicates(docs).count() == 0 and mixing.mixed_rows(docs).count() == 0


def test_the_cut_is_nearly_linear():
    from concilia.llm import html_extract

    page = lambda n: "<body>" + "<p>This is a sentence of eight words here.</p><p><a href='x'>link</a></p>" * n
    began = time.time()
    html_extract.extract(page(500))
    small = time.time() - began
    began = time.time()
    html_extract.extract(page(8000))
    assert time.time() - began < 40 * small + 2


def test_open_paragraphs_end_at_any_depth():
    from concilia.llm import html_extract

    for depth in (1, 7, 8, 30):
        page = "<article><div><p>" + "<b>" * depth + "One sentence of some words." + "<div>Another sentence of some words.</div></div></article>"
        found = html_extract.blocks(page)
        assert [b.text for b in found] == ["One sentence of some words.", "Another sentence of some words."]
        assert found[1].parent != found[0].parent or found[1].parent > 1


def test_min_cut_equals_brute_force_with_chains_and_siblings():
    from concilia.llm import html_extract

    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 9)
        scores = [rng.choice([rng.uniform(-3, 3), 0.0, 1.0, -1.0]) for _ in range(n)]
        edges = [(i - 1, i, rng.choice([1.0, 0.25])) for i in range(1, n)] + [(i - 2, i, 1.0) for i in range(2, n)]
        cost = lambda x: sum(abs(s) for s, k in zip(scores, x) if (s > 0) != k and s) + sum(w for i, j, w in edges if x[i] != x[j])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.min_cut(scores, edges)) - best) < 1e-6


def test_replies_gathered_from_exploded_examples(spark):
    from concilia.llm import chat

    data = [(1, 0, "user", "a"), (1, 1, "assistant", "b<\\"), (1, 2, "assistant", ""), (1, 3, None, None), (1, 4, "assistant", "c"),
            (None, 0, "assistant", "x"), (2, 0, "user", "q"), (3, 0, None, None)]
    convs = chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    key = lambda r: str(r.conv_id)
    one = sorted(chat.digests(chat.expanded(convs)).collect(), key=key)
    assert one == sorted(chat.digests(chat.read_back(convs)).collect(), key=key) and len(one) == 4
    assert chat.materialised(convs).filter("conv_id = 1").count() == 3
