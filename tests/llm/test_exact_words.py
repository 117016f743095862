"""Words are told apart by their bytes: structured words, and hashes made weak on purpose."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from genoloom.llm import decontaminate, html_extract, jaccard_join, language_id, quality_rules
from genoloom.llm import textscan as ts


def thue_morse(n, a="a", b="b"):
    """Two words of n letters on which polynomial hashes modulo a power of two agree."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("n", [2, 64, 256, 1024, 2048, 4096])
def test_structured_words_differ(n):
    w = ts.Words(pa.array([" ".join(thue_morse(n))]))
    assert w.count.tolist() == [2] and w.hash[0] != w.hash[1]


def test_hash_ignores_place_and_case():
    rng = random.Random(2)
    words = ["".join(rng.choice("abXé.") for _ in range(rng.randrange(1, 700))) for _ in range(200)]
    one, two = ts.Words(pa.array([" ".join(words)])), ts.Words(pa.array([None, "  pad " + "\n".join(x.upper() if x.isascii() else x for x in words)]))
    assert one.hash.tolist() == two.hash[1:].tolist()
    assert one.same_words(np.arange(200), two, np.arange(1, 201)).all()
    other = ts.Words(pa.array([" ".join(x[:-1] + ("y" if x[-1] != "y" else "z") for x in words)]))
    assert not one.same_words(np.arange(200), other, np.arange(200)).any()


def test_operators_on_structured_words(spark):
    a, b = thue_morse(1024)
    docs = spark.createDataFrame([(1, " ".join([a] * 12)), (2, " ".join([b] * 12))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join([a] * 10))], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.hits(decontaminate.find_contamination(docs, items)).collect()}
    assert (found[1]["n_hit"], found[2]["n_hit"], found[2]["contaminated"]) == (12, 0, False)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 2}
    n = quality_rules.text_counts(pa.array([" ".join([a] * 5 + [b] * 5), f"{a}\n{b}\n{a}"]))
    assert (n["n_repeat_words"].tolist(), n["n_dup_lines"].tolist()) == ([0, 0], [0, 1])


def repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(hit), len(lines) - len(set(lines))


def test_weak_hashes_change_no_count(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["x", "yy", "z" * 9, "w" * 300]) + rng.choice(" \n") for _ in range(rng.randrange(80))) for _ in range(40)]
    mix = ts.mix
    monkeypatch.setattr(ts, "mix", lambda x: mix(x) & np.uint64(7))
    n = quality_rules.text_counts(pa.array(texts))
    assert list(zip(n["n_repeat_words"].tolist(), n["n_dup_lines"].tolist(), strict=True)) == list(map(repeats, texts))


def test_weak_hashes_change_no_hit(monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)] + ["long" * 100, "long" * 99 + "lung"]
    items = [" ".join(rng.choices(words, k=12)) for _ in range(20)]
    texts = [" ".join([*rng.choices(words, k=30), *rng.choice(items).split()[: rng.choice([9, 10, 12])], *rng.choices(words, k=30)]) for _ in range(30)]
    mix = ts.mix
    monkeypatch.setattr(ts, "mix", lambda x: mix(x) & np.uint64(0x3FF))
    index = decontaminate.WindowIndex([str(i) for i in range(20)], items, 10)
    index.choose({s: np.zeros(len(known), np.int64) for s, known in index.known().items()})
    held = ts.Words(pa.array(texts), ts.ALNUM)
    start, w = index.occurrences(held, {s: held.windows(s) for s in index.kinds})
    got = {(int(held.of[a]), int(a - held.first[held.of[a]])) for a in start}
    known = {tuple(x.split()[i : i + 10]) for x in items for i in range(3)}
    want = {(t, i) for t, x in enumerate(texts) for i in range(len(x.split()) - 9) if tuple(x.split()[i : i + 10]) in known}
    assert got == want and len(index.start) == len(known)


def test_letters_are_letters(spark):
    rows = [(i, "the words of a text and more words of it here", "en") for i in range(8)] + [(i, "les mots du texte et encore des mots du texte", "fr") for i in range(8, 16)]
    odd = [(100, "½ ² ① Ⅷ 123 _"), (101, "é"), (102, None), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert [found[i] for i in (100, 102, 103)] == ["und"] * 3 and found[101] in ("en", "fr")


def test_ids_of_headings_name_their_content():
    page = '<article><h2 id="the-history-of-advertising">A</h2><p id="informed-consent">B</p><div id="sidebar">no</div><p class="advert">no</p></article>'
    assert [t for _, t in html_extract.blocks(page)] == ["A", "B"]


def test_rows_of_one_hash_stay(spark, sf_dir, monkeypatch):
    """Where the first hash tells nothing apart, no row is lost."""
    docs = spark.createDataFrame([(i, f"text number {i} with some words of its own {i * i}", "en", "s", 5) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    hashes = F.xxhash64

    class Weak:
        def __getattr__(self, name):
            return (lambda *c: hashes(*c) if not isinstance(c[0], str) else F.lit(1).cast("long")) if name == "xxhash64" else getattr(F, name)

    monkeypatch.setattr(corpus_pipeline, "F", Weak())
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()) == list(range(6))


def test_unmarked_articles_stay_whole(spark):
    """Passages that articles of a host share are no boilerplate, whether or not a page marks its article
    (hosts of the largest tables have 15 pages and more; of two or three pages half tells little)."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", r"<(/?)(article|main)\b", "<$1div"))
    text = lambda df: {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert text(bare) == text(pages)


def test_boilerplate_without_a_name_goes_by_the_array(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    said = lambda n: " ".join(rng.choices(words, k=n))
    top, bottom, quoted = said(12), said(30), said(40)
    rows, want = [], {}
    for i in range(40):
        body = [said(rng.randrange(20, 60)) for _ in range(4)]
        if i % 5 == 0:
            body.insert(2, quoted)  # a passage that a fifth of the articles quote
        want[i] = "\n".join(body)
        rows.append((i, f"http://h.example/{i}", "".join(f"<div>{x}</div>" for x in [top, *body, bottom])))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    parsed = {r["page_id"]: r["text"] for r in html_extract.parsed_pages(pages).collect()}
    found = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert found == want and sum(found[i] != parsed[i] for i in found) == 40
