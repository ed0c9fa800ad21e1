"""Fuzzy line deduplication by MinHash. DataFrame functions only.

Lines are compared in lower case without outer spaces. A line is the set of its
shingles of 8 characters (of 16 bits; a shorter line is one shingle); two lines
match when the Jaccard similarity of their sets is at least 0.8. Equal lines
collapse first, by 128 bits of hash. A line's set, hashed and sorted, forms a
ring; the ROWS hashes that follow each of BANDS fixed numbers are that band's
minimum hashes under one permutation, so a pair of similarity s shares a given
band with a chance of about s to the power ROWS, and one at the threshold some
band with 0.997. The lines of a band are compared with its first line, then any
two of them that matches do not connect yet. A comparison first bounds the
similarity by bitmaps, exactly, and then intersects the sets. Components of the
matches keep their first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.shared import connected_components, stored

SHINGLE, BANDS, ROWS = 8, 8, 3
#: Lines with fewer characters (in lower case, without outer spaces) match nothing.
MIN_CHARS = 20
#: Lines of a band that all its lines are compared with before the rest, and how often new
#: ones are chosen.
LEADERS = 8
LEADER_TURNS = 3
#: Lines of a block; every two blocks of a band meet under a key of their own.
BLOCK = 256
#: 64-bit words of a line's bitmap in the comparisons with a band's smallest line, and in the rest.
WORDS, WIDE = 16, 32
#: A line is common when it makes up this share of all lines.
COMMON = 1000
_STARTS = [-(1 << 63) + (2 * j + 1) * ((1 << 63) // BANDS) for j in range(BANDS)]
PLACE = ("none", "id", "uid", "pos")


def _units(line: Column) -> Column:
    """A line's characters, two bytes each: pieces of binary are cut without walking from its start."""
    return F.encode(line, "UTF-16BE")


def _begins(units: Column) -> Column:
    """Where a line's shingles begin, from 1."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(units) - (2 * SHINGLE - 1)), F.lit(2))


def _shingle(units: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(units, at, F.lit(2 * SHINGLE)))


def shingle_hashes(line: Column) -> Column:
    """The hashes of a line's shingles, repeated ones too."""
    return F.transform(F.array(_units(line)), lambda u: F.transform(_begins(u), lambda at: _shingle(u, at)))[0]


def band_rows(distinct: DataFrame) -> DataFrame:
    """(node, band) for the BANDS band keys (64 bits) of every line of distinct(node, line). The
    ring holds a repeated shingle once, so that lines of equal sets get equal keys."""
    ring = distinct.select("node", F.sort_array(F.array_distinct(shingle_hashes(F.col("line")))).alias("h"))
    starts = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(s).alias("s")) for j, s in enumerate(_STARTS)])
    merged = F.sort_array(F.concat("h", F.array(*[F.lit(s) for s in _STARTS])))
    rows = ring.select("node", F.concat("h", F.slice("h", 1, ROWS)).alias("ring"), merged.alias("merged")).withColumn("x", F.explode(starts))
    after = F.array_position("merged", F.col("x.s")).cast("int") - F.col("x.j")
    return rows.select("node", F.xxhash64("x.j", F.array_distinct(F.slice("ring", after, F.lit(ROWS)))).alias("band"))


def lines_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(none, id, uid, pos, line) for every line of every whole text (null: none).

    uid: a hash of the row's id and text; pos counts lines from 0; none: the
    row has no id. (none, id, uid, pos) is the place of a line.
    """
    doc_id = F.col(id_col).cast("long")
    base = docs.select(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), F.xxhash64(doc_id, F.col("text")).alias("uid"), "text")
    each = base.select("none", "id", "uid", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return each.select(*PLACE, F.lower(F.trim("raw")).alias("line"))


def keyed_lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """lines_of with h1 and h2, the 128 bits that tell lines apart."""
    return lines_of(docs, id_col).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def distinct_lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(h1, h2, line, first, n, node) of the different lines of MIN_CHARS or more: first is
    the smallest place (rows without an id last), n the number of places, node a number."""
    lines = keyed_lines(docs, id_col).where(F.length("line") >= MIN_CHARS)
    once = lines.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n"))
    return stored(once.withColumn("node", F.monotonically_increasing_id()), "lines")


def band_members(distinct: DataFrame) -> DataFrame:
    """(band, node, src) for every line of a band of two or more; src: its smallest node."""
    rows = stored(band_rows(distinct), "band-rows")
    least = rows.groupBy("band").agg(F.min("node").alias("src"), F.count("*").alias("n")).where("n > 1")
    return stored(rows.join(least.drop("n"), "band"), "band-members")


def bitmaps(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, shingles, b0, b1, ...): a bitmap of each line's shingles, and how many
    shingles the line has, repeated ones too."""
    each = texts.select("node", _units(F.col("line")).alias("units")).select("node", "units", F.explode(_begins(F.col("units"))).alias("at"))
    bits = each.select("node", F.pmod(_shingle(F.col("units"), F.col("at")), F.lit(64 * words)).cast("int").alias("bit"))
    word = lambda k: F.bit_or(F.when(F.floor(F.col("bit") / 64) == k, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}")
    return bits.groupBy("node").agg(F.count("*").cast("int").alias("shingles"), *[word(k) for k in range(words)])


def _sides(bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(bits.select(F.col("node").alias(end), *[F.col(c).alias(f"{p}_{c}") for c in bits.columns if c != "node"]) for end, p in (("src", "a"), ("dst", "b")))


def may_match(words: int = WORDS) -> Column:
    """An exact bound: every bit in which two bitmaps differ stands for a shingle that one
    set lacks, and sets that match lack at most a ninth of their sizes' sum."""
    differ = [F.bit_count(F.col(f"a_b{k}").bitwiseXOR(F.col(f"b_b{k}"))) for k in range(words)]
    return 9 * sum(differ[1:], differ[0]) <= F.col("a_shingles") + F.col("b_shingles")


def first_pairs(members: DataFrame, bits: DataFrame) -> DataFrame:
    """(src, dst): each line of a band with its smallest, where the bound allows a match."""
    pairs = members.where("node <> src").select("src", F.col("node").alias("dst")).distinct()
    a, b = _sides(bits)
    return pairs.join(a, "src").join(b, "dst").where(may_match()).select("src", "dst")


def open_rows(members: DataFrame, found: DataFrame, turn: int, leaders: bool) -> DataFrame:
    """(band, node, component, block, blocks, leads): the lines, but the smallest, of the bands
    whose lines lie in different components of found(node, component). About LEADERS of a
    band lead, others at each turn; without ``leaders``, only bands larger than that."""
    rows = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = rows.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least <> most")
    split = split.select("band", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    leads = (F.col("n") <= LEADERS) | (F.pmod(F.xxhash64(F.lit(turn), "band", "node"), F.col("n")) < LEADERS)
    rows = rows.where("node <> src").select("band", "node", "component").join(split, "band").withColumn("leads", leads)
    return stored((rows if leaders else rows.where(F.col("n") > LEADERS)).drop("n"), "band-rest")


def open_pairs(rows: DataFrame, bits: DataFrame, leaders: bool) -> DataFrame:
    """(src, dst): the pairs of open_rows of one band and different components that the
    bound allows; with ``leaders`` those that hold one. Blocks of about BLOCK lines meet two
    by two; the bound is part of the join, so that only what may match becomes a row."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    if leaders:
        first = dealt.where("leads").withColumn("hi", every).withColumn("lo", F.col("hi"))
        second = dealt.withColumns({"lo": F.col("block"), "hi": F.col("block")})
    else:
        first = second = dealt.withColumn("other", every).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    a, b = (
        side.select("band", "node", "component", "block", "lo", "hi").join(half.withColumnRenamed(end, "node"), "node").withColumnsRenamed({"node": end, "component": f"{end}_in", "block": f"{end}_block"})
        for side, end, half in zip((first, second), ("src", "dst"), _sides(bits), strict=True)
    )
    apart = F.col("src_in") != F.col("dst_in")
    if not leaders:
        apart = apart & (F.col("src") < F.col("dst")) & ((F.col("lo") == F.col("hi")) | (F.col("src_block") != F.col("dst_block")))
    met = a.join(b, ["band", "lo", "hi"]).where(apart & may_match(len(bits.columns) - 2))
    return met.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def merged(found: DataFrame, edges: DataFrame) -> DataFrame:
    """found(node, component) after joining what edges(src, dst) link."""
    ends = [found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")) for end in ("src", "dst")]
    between = edges.join(ends[0], "src", "left").join(ends[1], "dst", "left").select(F.coalesce("src_in", "src").alias("src"), F.coalesce("dst_in", "dst").alias("dst"))
    joined = connected_components(stored(between, "line-edges")).toDF("inner", "outer")
    moved = found.join(joined, F.col("component") == F.col("inner"), "left").select("node", F.coalesce("outer", "component").alias("component"))
    fresh = joined.join(found, F.col("inner") == F.col("node"), "left_anti").select(F.col("inner").alias("node"), F.col("outer").alias("component"))
    return stored(moved.union(fresh), "line-components")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (src, dst) of pairs whose sets match."""
    needed = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    texts = stored(texts.join(needed, "node", "left_semi"), "pair-texts")
    met = pairs.join(texts.toDF("src", "a"), "src").join(texts.toDF("dst", "b"), "dst")
    sets = met.select("src", "dst", F.array_distinct(shingle_hashes(F.col("a"))).alias("a"), F.array_distinct(shingle_hashes(F.col("b"))).alias("b"))
    sizes = F.struct(F.size("a").alias("a"), F.size("b").alias("b"), F.size(F.array_intersect("a", "b")).alias("both"))
    # a generated column keeps the optimizer from copying the sets into the condition
    counted = sets.select("src", "dst", F.explode(F.array(sizes)).alias("n"))
    return counted.where("9 * n.both >= 4 * (n.a + n.b)").select("src", "dst")


def matching_components(distinct: DataFrame) -> DataFrame:
    """(node, component) of the lines that match another's.

    Any two lines of a band are compared, unless they are in one component
    already: each with the band's smallest line, then with some leaders of the
    bands that several components meet in, which joins most groups of near
    copies, and then whatever is left between components.
    """
    members = band_members(distinct)
    texts = stored(distinct.select("node", "line").join(members.select("node").distinct(), "node", "left_semi"), "line-texts")
    bits = stored(bitmaps(texts), "line-bitmaps")
    tested = stored(first_pairs(members, bits), "line-pairs")
    edges = verified(tested, texts)
    found = stored(connected_components(stored(edges, "line-edges")), "line-components")
    for turn in range(LEADER_TURNS + 1):
        leaders = turn < LEADER_TURNS
        rows = open_rows(members, found, turn, leaders)
        if turn == 0:
            bits = stored(bitmaps(texts.join(rows.select("node").distinct(), "node", "left_semi"), WIDE), "line-bitmaps")
        # a pair compared before lies in two components because it does not match; stored first,
        # so that the bound's code stays small enough to be compiled
        pairs = stored(open_pairs(rows, bits, leaders), "line-pairs")
        pairs = stored(pairs.join(tested, ["src", "dst"], "left_anti"), "line-pairs")
        if not pairs.isEmpty():
            found = merged(found, verified(pairs, texts))
            tested = tested.union(pairs)
    return found


def heads(distinct: DataFrame) -> DataFrame:
    """(h1, h2, n, head) for the lines that stand in several places or match others; head: the
    first place of the line's component."""
    known = distinct.select("h1", "h2", "first", "n", "node").join(matching_components(distinct), "node", "left")
    firsts = known.where("component is not null").groupBy("component").agg(F.min("first").alias("head"))
    repeated = known.where("component is not null or n > 1").join(firsts, "component", "left")
    return stored(repeated.select("h1", "h2", "n", F.coalesce("head", "first").alias("head")), "line-heads")


def line_decisions(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(none, id, uid, pos, head, kept) for every line of docs; head is the place that the
    line's component keeps (its own, where nothing matches).

    Of each component of matching lines the first place stays: the smallest id
    (rows without one last), then uid, then pos. Rows with equal id and text are
    one document and keep the same lines. Lines under MIN_CHARS, empty ones too,
    match nothing and stay; a null text has no lines; other columns are ignored;
    an empty table gives no rows. Lines that make up a thousandth of all or more
    (at most a thousand) get their heads by broadcast, so that no task holds all
    places of a common line.
    """
    distinct = distinct_lines(docs, id_col)
    head = heads(distinct)
    least = max(COMMON, (distinct.agg(F.sum("n")).first()[0] or 0) // COMMON)
    common = F.broadcast(head.where(F.col("n") >= least).select("h1", "h2", F.col("head").alias("common")))
    places = keyed_lines(docs, id_col).select("h1", "h2", F.struct(*PLACE).alias("place"), (F.length("line") < MIN_CHARS).alias("short")).join(common, ["h1", "h2"], "left")
    # a line without a head to look for is dealt by its place
    k1 = F.when(F.col("short") | F.col("common").isNotNull(), F.xxhash64("place")).otherwise(F.col("h1"))
    rest = head.where(F.col("n") < least).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "head")
    joined = places.withColumns({"k1": k1, "k2": F.col("h2")}).join(rest, ["k1", "k2"], "left")
    own = F.when(F.col("short"), F.col("place")).otherwise(F.coalesce("common", "head", "place"))
    return joined.select("place.*", own.alias("head")).withColumn("kept", F.struct(*PLACE) == F.col("head"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with the matching lines but the first removed from their texts, and n_chars,
    where there is one, counted anew. Documents that lose all their words go;
    those that had none (null texts too) stay as they are. Columns are left as
    they are, whatever their names."""
    gone = line_decisions(docs, id_col).where("not kept").groupBy("none", "id", "uid").agg(F.collect_set("pos").alias("gone"))
    doc_id = F.col(f"row.`{id_col}`").cast("long")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = keyed.withColumns({"none": doc_id.isNull(), "id": F.coalesce(doc_id, F.lit(0).cast("long")), "uid": F.xxhash64(doc_id, F.col("row.text"))})
    joined = keyed.join(gone, ["none", "id", "uid"], "left")
    rest = F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(rest, "\n"))
    out = joined.withColumn("left", text).where(F.col("gone").isNull() | F.rlike("left", F.lit(r"[^\x20\x09-\x0D]")))
    made = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("left")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    named = lambda none, doc: F.when(~none, doc)
    return got.select(
        named(F.col("none"), F.col("id")).alias("doc_id"), F.col("pos").alias("line_no"), named(F.col("head.none"), F.col("head.id")).alias("first_doc_id"), F.col("head.pos").alias("first_line_no"), "kept"
    )
