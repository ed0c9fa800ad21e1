"""The pipeline's stages, each against a brute-force version on what it was given."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from roadgrain.llm import line_dedup, mixing, packing, quality
from tests.llm.test_operators import components, jaccard, shingles, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    para = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(8, 25))) for _ in range(n))
    common = " ".join(rng.choice(words) for _ in range(15))
    texts = [para(rng.randint(4, 9)) for _ in range(40)]
    texts += [t + "\n" + common for t in texts[:10]] + [texts[3], None, "", "ha " * 90, "short text"]
    for t in texts[:8]:
        w = t.split(" ")
        w[len(w) // 2] = "edit"
        texts.append(" ".join(w))
    rows = [(i, t, "en", f"src{i % 4}" if i % 5 else "other", len(t or "")) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def line_brute(rows):
    sets, occurrences = {}, []
    for doc, text, *_ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip(" ").lower()
            if len(line) >= line_dedup.MIN_CHARS:
                sets[line] = {line[i : i + line_dedup.SHINGLE] for i in range(len(line) - line_dedup.SHINGLE + 1)}
                occurrences.append((doc, pos, line))
    group, first = components(sets, jaccard), {}
    for o in sorted(occurrences):
        first.setdefault(group[o[2]], o)
    gone = {o[:2] for o in occurrences if first[group[o[2]]] != o}
    out = []
    for doc, text, lang, source, n in rows:
        if any(d == doc for d, _ in gone):
            text = "\n".join(x for pos, x in enumerate(text.split("\n")) if (doc, pos) not in gone)
            if not words_of(text):
                continue
            n = len(text)
        out.append((doc, text, lang, source, n))
    return out


def test_stages(spark, corpus):
    sf_dir, rows = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    verdicts = {r["doc_id"]: r["kept"] for r in quality.quality_metrics(docs).collect()}
    want = [r for r in rows if verdicts[r[0]]]
    assert not any(verdicts[r[0]] for r in rows if len(words_of(r[1])) < 50) and sum(verdicts.values()) > 40
    given = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, given, sf_dir)
        if k == 1:
            want = line_brute(want)
        elif k == 2:
            sets = {r[0]: shingles(r[1]) for r in want}
            stands = components(sets, jaccard)
            want = [r for r in want if stands[r[0]] == r[0]]
        elif k == 3:
            n, out = collections.Counter(r[3] for r in want), []
            mass = sum(w for s, w in mixing.WEIGHTS.items() if n[s])
            for r in want:
                u = (int(hashlib.md5(f"{r[0]}|{mixing.SEED}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
                rate = mixing.WEIGHTS.get(r[3], 0) / mass * len(want) / n[r[3]]
                out += [r] * (sum(p < u for p in mixing.poisson_cdf(rate)) if r[3] in mixing.WEIGHTS else 1)
            want = out
        if k < 4:
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
            assert sorted(map(tuple, got.collect())) == sorted(want)
            given = spark.createDataFrame(sorted(want), SCHEMA)
    encoder = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER_FILE))
    total = sum(len(encoder.tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in want)
    last = got.collect()
    assert sum(r["length"] for r in last) == total
    assert collections.Counter((r["doc_id"], r["start"]) for r in last if r["start"] == 0) == collections.Counter((r[0], 0) for r in want)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(tuple(r[c] for c in columns) for r in whole) == sorted(tuple(r[c] for c in columns) for r in last)
    assert np.all(np.array([r["length"] for r in whole]) <= packing.CAPACITY)
