"""WARC archives, the Merkle manifest and collocations, each against a plain version; and rows
whose extra columns have the operators' own names."""

import collections
import gzip
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgrain.llm import html_text, line_dedup, merkle, mixing, ngram_join, phrases, warc

HELPERS = ["row", "name", "node", "id", "part", "cdf", "u", "n", "copy", "__source", "__cdf", "__u", "__n", "__node", "tie", "pos", "size", "group", "leaf", "chunk", "count", "final", "key", "first", "payload", "common", "band", "place", "gone", "left"]


# --- archives


def pages_of(rng):
    long = "long page " * 30000
    texts = [None, "", "x" * 99, "y" * 100, "é" * 50, long, long, "y" * 100, "x" * 99, "WARC/1.1\r\n\r\n" + "z" * 200, "\x1f\x8b\x08" + "q" * 300, "<p>a</p>\r\n\r\n" * 20]
    texts += ["".join(rng.choice("ab <p>\n") for _ in range(rng.randint(0, 4000))) for _ in range(60)] + ["y" * 100] * 9
    rows = [(i * 3, f"http://a/{i}\r\nX: 1" if i % 9 else None, t, 5, "r") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[20], (None, "u", texts[5], 1, "r"), (None, "u", "only without an id " * 9, 1, "r"), (None, "u", "only without an id " * 9, 1, "r")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    rows = pages_of(random.Random(4))
    path = str(tmp_path_factory.mktemp("warc") / "a")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int, record_type string").repartition(3)
    warc.write_archives(pages, path, file_bytes=20_000)
    return rows, path


def test_records_come_back_whatever_the_ranges(spark, archive):
    rows, path = archive
    want, first = [], {}
    for i, _, t, *_ in rows:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(i, first.get(t, i))
    for i, _, t, *_ in rows:
        body = (t or "").encode()
        head = first.get(t)
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if head is None or head == i else "revisit", None if head is None or head == i else head))
    whole = None
    for split in (777, 5000, 1 << 30):
        got = warc.read_archives(spark, path, split)
        assert sorted(map(repr, map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))) == sorted(map(repr, want))
        places = sorted((r["file"], r["offset"]) for r in got.select("file", "offset").collect())
        assert whole in (None, places) and len(set(places)) == len(rows)
        whole = places
    bodies = {r["record_id"]: bytes(r["payload"]) for r in got.where("record_type = 'response'").collect()}
    for r in got.where("record_type = 'revisit'").collect():  # a revisit names a record that holds its payload
        assert r["payload"] is None and hashlib.sha256(bodies[r["refers_to_id"]]).hexdigest() == r["payload_digest"]
    assert not got.where("target_uri like '%\\n%'").count() and got.where("target_uri like 'http://a/1\\%0D\\%0AX: 1'").count() == 1


def test_archives_are_plain_warc_gz(archive):
    import glob

    rows, path = archive
    files = glob.glob(f"{path}/*.warc.gz")
    assert len(files) > 3 and not glob.glob(f"{path}/_attempts")
    text = b"".join(gzip.open(f).read() for f in files)
    stream, n = io.BytesIO(text), 0
    while line := stream.readline():
        assert line == b"WARC/1.1\r\n"
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            k, _, v = line.decode().partition(": ")
            fields[k] = v.strip()
        block = stream.read(int(fields["Content-Length"]))
        assert stream.read(4) == b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n") and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
        n += 1
    assert n == len(rows)


def test_foreign_damaged_and_stray_bytes(spark, tmp_path):
    member = lambda payload, kind=b"resource": warc.gzip_member(b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n")
    stray = warc.MAGIC + b"\x00" * 7 + warc.gzip_member(b"no record") + b"\x1f\x8b"
    data = member(b"one" * 500, b"warcinfo") + stray + member(b"") + gzip.compress(b"", mtime=0) + member(bytes(range(256)) * 40)
    (tmp_path / "a.warc.gz").write_bytes(data)
    for split in (64, 1 << 20):
        got = warc.read_archives(spark, str(tmp_path / "a.warc.gz"), split).orderBy("offset").collect()
        assert [(r["record_type"], r["payload_bytes"], r["page_id"]) for r in got] == [("warcinfo", 1500, None), ("resource", 0, None), ("resource", 10240, None)]
        assert bytes(got[2]["payload"]) == bytes(range(256)) * 40
    (tmp_path / "a.warc.gz").write_bytes(data[:-300])
    with pytest.raises(Exception, match="ends inside the record|ends before"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


# --- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[at - at % 8 : at], nodes[at + 1 : at - at % 8 + 8]))
        at //= 8
    return out


def leaf(row, tampered=False):
    row = [*row[:4], row[4].translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) if tampered and row[4] is not None else row[4]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def manifest_rows(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    low = {g: tree([leaf(r) for r in by[g]]) for g in langs}
    high = tree([low[g][-1][0] for g in langs])
    for k, g in enumerate(langs):
        for at, r in enumerate(by[g]):
            steps = siblings(low[g], at) + siblings(high, k)
            digest = leaf(r, r[0] is not None and merkle.is_tampered(r[0]))
            for left, right in steps:
                digest = h(*left, digest, *right)
            yield r[0], leaf(r), low[g][-1][0], high[-1][0], h(*[x for left, right in steps for x in left + right]), digest, digest == high[-1][0]


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [4, 1, 2])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "CHUNK", 8**levels)
    rng = random.Random(levels)
    rows = [(rng.randint(-99, 5000), rng.choice([None, "s", "-"]), rng.choice(["en"] * 9 + ["de", "é", "zz", None]), rng.choice([None, 7]), rng.choice([None, "", "Ab É", "12:x", "A" * 3000])) for _ in range(700)]
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, "s", "one", 1, "T"), (9, "s", "fr", 1, "T"), (9, "s", "fr", 1, "T")]
    rows += [(i, "s", f"l{i}", 1, "Text") for i in range(80)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], FIELDS + ", digest string, level int").repartition(5)
    got = sorted(map(repr, map(tuple, merkle.check_documents(docs).collect())))
    assert got == sorted(map(repr, manifest_rows(rows)))


def test_small_manifests(spark):
    for rows in ([], [(5, "s", "en", 3, "ABC")], [(5, "s", "en", 3, "ABC"), (5, "s", "de", 3, "ABC")]):
        got = merkle.check_documents(spark.createDataFrame(rows, FIELDS)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, manifest_rows(rows)))


def test_states_are_resumed():
    nodes = [h(str(i)).encode() for i in range(100)]
    tree8 = merkle.Subtree(nodes, 3)
    for at in (0, 7, 8, 63, 99):
        other = h("other").encode()
        assert tree8.fold(at, other) == merkle.Subtree([*nodes[:at], other, *nodes[at + 1 :]], 3).levels[-1][0]
        assert tree8.fold(at, nodes[at]) == tree8.levels[-1][0]
    assert [merkle.depth(n) for n in (0, 1, 2, 8, 9, 64, 65, 8**10)] == [0, 0, 1, 1, 2, 2, 3, 10]


# --- collocations


def plain_collocations(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {}
    for p, a in f.items():
        if len(p) > 2 and a >= least:
            lang, *w = p
            score, cut = min((2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
            found[p] = (a, f[(lang, *w[:cut])], f[(lang, *w[cut:])], score)
    gone = {(p[0], *p[i:j]) for p in found for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and 100 * found[p][0] >= 80 * found[(p[0], *p[i:j])][0]}
    out, rank = [], collections.Counter()
    for p in sorted(found.keys() - gone, key=lambda p: (p[0], -found[p][3], -found[p][0], " ".join(p[1:]).encode())):
        rank[p[0]] += 1
        a, left, right, score = found[p]
        if rank[p[0]] <= top:
            out.append((p[0], rank[p[0]], " ".join(p[1:]), a, left, right, n[p[0]], score))
    return out


def phrase_rows(rng):
    words = ["".join(rng.choice("abcéß- \x0e") for _ in range(rng.randint(1, 3))) for _ in range(25)]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", " ;", "\r"]) for _ in range(n))
    common = " ".join(rng.choice(words) for _ in range(60))
    rows = [(rng.choice(["en", "en", "de", None, "und"]), say(rng.randint(0, 120))) for _ in range(150)]
    rows += [("en", common)] * 40 + [("de", common.upper())] * 3 + [("en", None), ("en", ""), (None, ".,;"), ("en", "ha " * 3000), ("one", "word"), ("en", "x" * 9000)]
    return rows


@pytest.mark.parametrize("trigger, bits, top", [(16, 1 << 27, 2000), (1, 64, 7), (3, 1 << 12, 2000)])
def test_collocations(spark, monkeypatch, trigger, bits, top):
    monkeypatch.setattr(phrases, "TRIGGER", trigger)
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    monkeypatch.setattr(phrases, "COUNT_BYTES", 3000)
    rows = phrase_rows(random.Random(8))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, count long, chunk string").repartition(4)
    got = sorted(map(tuple, phrases.collocations(docs, top).collect()))
    assert got == sorted(plain_collocations(rows, 30, top)) and len(got) > (20 if top > 7 else 6)


def test_chunks_overlap_and_cover(spark):
    rows = phrase_rows(random.Random(9))
    dictionary = phrases.parsed(spark.createDataFrame(rows, "lang string, text string")).collect()
    counts = collections.Counter()
    for r in dictionary:
        w = r["chunk"].split(" ")
        own = len(w) if r["final"] else len(w) - phrases.OVERLAP
        assert own > 0
        for i in range(own):
            counts[(r["lang"], *w[i : i + 4])] += r["count"]
    want = collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or "und", *w[i : i + 4]) for i in range(len(w)))
    assert counts == want
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


# --- clashing names, and what was lost before


def test_extra_columns_may_have_any_name(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["red", "blue", "green", "tall", "small"]) + str(rng.randint(0, 99)) for _ in range(n))
    texts = [say(40) for _ in range(12)]
    rows = [(i, t, "en", f"src{i % 2}", 5, *range(len(HELPERS))) for i, t in enumerate([*texts, texts[0], texts[1] + " more", None])]
    names = ["doc_id", "text", "lang", "source", "n_chars", *HELPERS]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'string' if c in ('text', 'lang', 'source') else 'long'}" for c in names))
    for out in (mixing.mix_sources(docs, {"src0": 2.0, "src1": 1.0}), ngram_join.keep_one_per_group(docs), line_dedup.dedup_lines(docs)):
        got = out.collect()
        assert len(got) > 5 and [c for c in out.columns if c in HELPERS and c != "copy"] == [c for c in HELPERS if c in out.columns and c != "copy"]
        assert all(r[c] == k for r in got for k, c in enumerate(HELPERS) if c != "copy") and {r["doc_id"] for r in got} <= set(range(15))
    plain = docs.select("doc_id", "source", "lang", "n_chars", "text")
    assert sorted(map(tuple, merkle.check_documents(docs).collect())) == sorted(map(tuple, merkle.check_documents(plain).collect()))


def test_large_rates_are_drawn_in_parts(spark):
    docs = spark.createDataFrame([(i, "t", "rare" if i < 3 else "rest") for i in range(2003)], "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, {"rare": 1.0, "rest": 1.0})
    n = {r[0]: r[1] for r in out.where("source = 'rare'").groupBy("doc_id").count().collect()}
    rate = 2003 / 2 / 3
    assert len(n) == 3 and all(abs(v - rate) < 5 * rate**0.5 for v in n.values())
    assert out.select("doc_id", "copy").distinct().count() == out.count()
    assert max(len(mixing.poisson_cdf(r)) for r in (0.1, 1, 30, mixing.MAX_RATE)) <= mixing.STRIDE


def test_lines_of_equal_sets_share_all_bands(spark):
    lines = []
    for unit in ("=-+", ". ", "xy z", "-", "*~*~ ", "abcdefgh", "=-=+-", "0123456789"):
        for n in (40, 41, 47, 60, 120, 300):
            lines.append((unit * n)[: n + 30])
    sets = [frozenset(x[i : i + 8] for i in range(max(1, len(x) - 7))) for x in (y.strip(" ") for y in lines)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    head = {r["id"]: r["head"]["id"] for r in line_dedup.line_decisions(docs).collect()}
    equal = [(i, j) for i in range(len(lines)) for j in range(i) if sets[i] == sets[j]]
    assert len(equal) > 60 and all(head[i] == head[j] for i, j in equal)


def test_hidden_elements_that_close_themselves_or_never():
    text = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert text("<p>one</p><svg width=1 /><p>two</p>") == ["one", "two"] == text('<p>one</p><object data="x"/><p>two</p>') == text("<p>one</p><iframe src=a><p>two</p>")
    assert text("<p>one</p><svg><path/>no</svg><p>two</p><script>never") == ["one", "two"] == text('<p>one</p><script src="a/b"></script><style>p {}</style><p>two</p>')


def test_long_blocks_are_hashed_whole():
    block = html_text.blocks_of("<p>" + "same " * 500 + "end" + "</p>")
    other = html_text.blocks_of("<p>" + "same " * 500 + "other" + "</p>")
    assert np.abs(html_text.features(block) - html_text.features(other)).max() > 0
