"""Columns that bear the operators' own helper names change nothing, and the pipeline over
empty tables, repeated rows, null ids and such columns."""

import random
import re
from pathlib import Path

import pytest

import corpus_pipeline
from roadgrain.llm import html_text, line_dedup, mixing, ngram_join, packing, phrases, quality, secrets, sharding, token_counts, warc

OWN = {"doc_id", "text", "lang", "source", "n_chars", "page_id", "url", "html", "vec_id"}
BASE = "doc_id long, text string, lang string, source string, n_chars long"


def helper_names():
    """Every name that a module of the subpackage gives to a column."""
    found = set()
    for path in Path(token_counts.__file__).parent.glob("*.py"):
        code = path.read_text()
        for pattern in (r'alias\("(\w+)"\)', r'withColumn\("(\w+)"', r'"(__\w+)"', r'withColumns\(\{"(\w+)"', r", \"(\w+)\": F\."):
            found |= set(re.findall(pattern, code))
    return sorted(n for n in found if n.lower() not in OWN)


def texts():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["red", "blue", "green", "tall", "small"]) + str(rng.randint(0, 99)) for _ in range(n))
    some = [say(80) + "\n" + say(9) for _ in range(10)]
    return [*some, some[0], some[1] + " more", None, "", "secret: token = abcdefghijkl " + say(60), "ha " * 90]


@pytest.fixture(scope="module")
def both(spark):
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts())]
    names = helper_names()
    wide = ", ".join([BASE, *[f"`{n}` long" for n in names]])
    assert len(names) > 40
    return spark.createDataFrame(rows, BASE), spark.createDataFrame([(*r, *range(len(names))) for r in rows], wide)


OPERATORS = {
    "token counts": (token_counts.count_tokens, None), "packing": (packing.packed_digest, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]), "sharding": (lambda d: sharding.shard_documents(d, shards=4), ["doc_id", "size"]),
    "line decisions": (line_dedup.line_decisions, None), "lines": (line_dedup.dedup_lines, [c.split()[0] for c in BASE.split(", ")]), "n-grams": (ngram_join.near_duplicates, None), "n-gram groups": (ngram_join.keep_one_per_group, [c.split()[0] for c in BASE.split(", ")]),
    "mixing": (lambda d: mixing.mix_sources(d, {"src0": 2.0, "src1": 1.0}), ["doc_id", "text"]), "secrets": (secrets.scan_secrets, None), "quality": (quality.quality_metrics, None), "quality filter": (quality.filter_quality, ["doc_id", "text"]), "phrases": (phrases.collocations, None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_helper_names_as_columns(both, name):
    plain, wide = both
    operator, columns = OPERATORS[name]
    want, got = operator(plain), operator(wide)
    columns = columns or want.columns
    assert sorted(map(repr, want.select(*columns).collect())) == sorted(map(repr, got.select(*columns).collect()))


def test_helper_names_as_columns_of_pages(spark):
    names = helper_names()
    pages = [(i, f"http://x/{i}", f"<html><body><nav>menu home</nav><article><p>words of page {i % 3} and some more of them to read</p></article></body></html>" if i != 4 else None) for i in range(6)]
    plain = spark.createDataFrame(pages, "page_id long, url string, html string")
    wide = spark.createDataFrame([(*p, *range(len(names))) for p in pages], ", ".join(["page_id long, url string, html string", *[f"`{n}` long" for n in names]]))
    shown = ["page_id", "payload_digest", "record_type", "refers_to"]
    a, b = warc.records_of(plain), warc.records_of(wide)
    shown = [c for c in shown if c in a.columns]
    assert sorted(map(repr, a.select(*shown).collect())) == sorted(map(repr, b.select(*shown).collect()))
    labeller = html_text.train(["alpha", "beta", "gamma", "delta"], pages=8, epochs=1)
    a, b = (sorted(map(repr, html_text.extract_main_text(p, labeller).select("page_id", "text").collect())) for p in (plain, wide))
    assert a == b and len(a) == 6


def run(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_over_no_documents(spark, tmp_path):
    assert run(spark, tmp_path, [], BASE) == []


def test_pipeline_over_repeats_null_ids_and_helper_names(spark, tmp_path):
    names = helper_names()
    kept = [(i, t, "en", "no such source", len(t)) for i, t in enumerate(texts()[:10])]
    rows = [*kept, kept[3], kept[3], (None, "zz " + kept[5][1][3:].upper()[::-1], None, None, 1), (77, None, None, None, None), (78, "", None, None, 0)]
    out = run(spark, tmp_path, [(*r, *range(len(names))) for r in rows], ", ".join([BASE, *[f"`{n}` long" for n in names]]))
    starts = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out if r["start"] == 0)
    assert [d for none, d in starts if not none] == list(range(10)), "repeats go, whole documents stay, empty ones fail the rules"
    assert sum(none for none, _ in starts) == 1
