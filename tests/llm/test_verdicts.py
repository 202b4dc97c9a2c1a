"""Verdicts of quality rules against an estimate on sorted vectors, and labels of pages without semantic wrappers."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from concilia.llm import html_extract, quality as Q


def _vector(text):
    counts = dict(zip(Q.COUNTS, Q.text_counts(text)))
    out = []
    for name, (stat, typical, _) in Q.COORDINATES.items():
        share = (counts[stat] + Q.PRIOR * typical) / (counts["n_words"] + Q.PRIOR)
        out.append(math.log(share) if name == "length" else math.sqrt(share))
    return counts, np.array(out)


def _mcd(x):
    """Concentration steps over the whole group, by sorting: centre and inverse scatter."""
    floors = np.array(Q.FLOORS)
    centre = np.median(x, axis=0)
    low, high = np.quantile(x, [0.25, 0.75], axis=0)
    weights = np.diag(1 / np.maximum((high - low) / 1.349, floors) ** 2)
    for _ in range(Q.STEPS):
        d = np.einsum("ni,ij,nj->n", x - centre, weights, x - centre)
        core = x[np.argsort(d, kind="stable")[:math.ceil(Q.SUPPORT * len(x))]]
        centre = core.mean(axis=0)
        cov = (core - centre).T @ (core - centre) / len(core)
        weights = np.linalg.inv(cov / Q.CONSISTENCY + np.diag(floors ** 2))
    return centre, weights


def _corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "house", "winter", "running", "a", "green", "river", "to", "stone", "because", "sun", "mountain", "is"]
    rows = []
    for lang, source, n in (("en", "s0", 400), ("en", "s1", 150), ("de", "s0", 90)):
        for _ in range(n):
            kind = rng.random()
            w = [rng.choice(words) + rng.choice(["", "", "", "", ",", "."]) for _ in range(rng.randint(20, 200))]
            if kind < 0.06:
                w = [x.upper() + "!!" for x in w]
            elif kind < 0.1:
                w = [x + "###" for x in w]
            elif kind < 0.13:
                w = [x * 6 for x in w]
            rows.append((len(rows), " ".join(w), lang, source))
    return rows


def test_outliers_equal_an_estimate_on_sorted_vectors(spark):
    rows = _corpus(4)
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    groups = defaultdict(list)
    for i, text, lang, source in rows:
        counts, v = _vector(text)
        failed = counts["n_words"] < Q.MIN_WORDS or 100 * counts["n_repeat_words"] > Q.MAX_REPEAT * counts["n_words"]
        assert got[i].base_failed == failed
        if not failed:
            groups[lang, source].append((i, v))
    compared = rejected = 0
    for members in groups.values():
        assert len(members) >= Q.MIN_ROWS
        x = np.array([v for _, v in members])
        centre, weights = _mcd(x)
        for (i, _), d in zip(members, np.einsum("ni,ij,nj->n", x - centre, weights, x - centre)):
            assert got[i].distance == pytest.approx(d, rel=0.25, abs=1.5)
            if abs(math.log(max(d, 1e-9) / Q.CUTOFF)) > 0.3:
                compared += 1
                rejected += d > Q.CUTOFF
                assert got[i].kept == (d <= Q.CUTOFF)
    assert compared > 0.95 * sum(map(len, groups.values())) and rejected > 20


TEXT = ["The valley lies between two mountains and is known for its rivers, its old bridges and its long winters.",
        "People have lived there for many hundred years, and most of them worked in the woods or on small farms.",
        "In the last century a railway was built along the river, and with it came visitors from the towns of the plain.",
        "Today there are three villages in the valley, each of which has a school, a shop and a church from the time of the first farms."]
LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Weather", "Shop", "About us", "Contact"))


@pytest.mark.parametrize("page", [
    # no element or class says what is content; only texts, links and neighbours do
    "<body><div><ul>{links}</ul></div><div>{paragraphs}</div><div><ul>{links}</ul></div></body>",
    "<body><table><tr><td><ul>{links}</ul></td><td>{paragraphs}</td></tr></table></body>",
    "<body><div><div><a href='/'>Start</a> | <a href='/m'>Map</a></div><div><div>{paragraphs}</div></div></div></body>",
    "<body><ul>{links}</ul>{paragraphs}<ul>{links}</ul></body>",
    "<body><div class='x1'><span><a href='/'>Logo</a></span></div><div class='x2'>{divs}</div><div class='x3'>{links}</div></body>"])
def test_pages_without_semantic_wrappers(page):
    paragraphs = "".join(f"<p>{t}</p>" for t in TEXT)
    divs = "".join(f"<div>{t}</div>" for t in TEXT)
    assert html_extract.extract(page.format(links=LINKS, paragraphs=paragraphs, divs=divs)) == "\n".join(TEXT)


def test_many_sentences_between_links():
    """Texts stay and links go where they alternate, with sentences of common length."""
    rng = random.Random(2)
    said = [" ".join(rng.choice(TEXT[k % 4].split()) for _ in range(rng.randint(14, 30))) + "." for k in range(200)]
    page = "<body>" + "".join(f"<p>{t}</p><p><a href='/{k}'>more</a></p>" for k, t in enumerate(said)) + "</body>"
    assert html_extract.extract(page).split("\n") == said
