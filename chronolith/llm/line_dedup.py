"""Near-duplicate lines by a segment-partition edit join, with DataFrame functions only.

Two lines within ``tau`` edits: when the shorter is cut into tau + 1 segments,
the longer one contains one of them unchanged, at nearly the same place.  So
each line is indexed under its segments, and probes, for each length that it may
match, the substrings that a segment could have moved to (length, segment number and
text are the key).  Candidates are verified by a banded bit-parallel
computation of their edit distance: the 2 tau + 1 cells of a column that can
matter are bits of one integer.

In a bucket every line is first compared with the smallest indexed line; then all
pairs of indexed and probing lines that are still in different classes are
compared, so no link between classes is lost and a bucket of near copies
makes as many pairs as it has lines.  Of each class the first line (by
document, then position) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import free_name, semi_by_key, small, stored, table
from chronolith.llm.components import components

#: Most edits between near-duplicate lines, and the fewest characters of a line that is compared.
TAU, LEAST_CHARS = 2, 24
#: A line that occurs so often is indexed once, at its first occurrence.
OFTEN = 4
#: Measured tables below this are broadcast.
BYTES = 32 << 20
#: What orders lines: the first of a class stays.
PLACE = ("doc", "text", "pos")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def trimmed(line: Column) -> Column:
    """A line without white space at its ends; what lines are compared by."""
    return F.btrim(line, F.lit(" \t\r\x0b\x0c\x00"))


def occurrences(docs: DataFrame, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, pos, line, id): lines long enough to compare, of documents with an id;
    ``text`` tells apart the texts of rows that repeat an id."""
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_col).alias("text"),
        F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"),
    )
    rows = rows.withColumn("line", trimmed(F.col("line")))
    rows = rows.where(F.char_length("line") >= least_chars)
    return rows.withColumn("id", F.xxhash64("line"))


def add_keys(lines: DataFrame, tau: int) -> DataFrame:
    """(id, key, own) from (id, line): what a line is indexed under (own) and probes.

    A line of n characters has tau + 1 even segments, the longer ones last.  A
    key hashes the indexed length, the segment's number and its text.  The
    places that a segment may have moved to are those from which the edits left
    of it and those right of it can both be made up for.  Lengths and starts
    are columns of their own, so that each is computed once.
    """
    n, parts = "_n", tau + 1
    lengths = {f"_base{k}": F.expr(f"cast((_n - {k}) div {parts} as int)") for k in range(parts)}
    longer = {f"_more{k}": F.expr(f"cast(greatest(_n - {k}, 0) % {parts} as int)") for k in range(parts)}
    lines = lines.withColumn(n, F.char_length("line")).withColumns(lengths | longer)
    out = []
    for less in range(parts):  # the indexed line is shorter by this
        base, more = F.col(f"_base{less}"), F.col(f"_more{less}")
        for i in range(parts):
            start = base * i + F.greatest(more - (parts - i), F.lit(0))
            size = base + F.when(more >= parts - i, 1).otherwise(0)
            low, high = max(-i, less - (tau - i)), min(i, less + (tau - i))
            for move in range(low, high + 1):
                text = F.substring(F.col("line"), start + (move + 1), size)
                inside = (start + move >= 0) & (start + move + size <= F.col(n)) & (size > 0)
                key = F.when(inside, F.xxhash64(F.col(n) - less, F.lit(i), text))
                out.append(F.struct(key.alias("key"), F.lit(less == 0 and move == 0).alias("own")))
    return (
        lines.select("id", F.array(*out).alias("_keys"))
        # explode() would have the whole array computed in a filter first
        .select("id", F.explode_outer("_keys").alias("_k"))
        .select("id", "_k.key", "_k.own")
        .where("key is not null")
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether two arrays of code points are within ``tau`` edits of each other.

    Bit t of the band stands, in column j (b's character j), for row
    j - tau + t (a's character).  vp and vn hold the rows whose value is one more or
    less than that of the row above; the distance is followed along the diagonal that
    ends in the last cell, where it grows by one wherever the diagonal step is not free.
    """
    width, mask = 2 * tau + 1, (1 << (2 * tau + 1)) - 1
    shift = F.size(a) - F.size(b)

    def masked(x: Column) -> Column:
        return x.bitwiseAND(F.lit(mask).cast("long"))

    def equal(j: Column) -> Column:
        c = F.get(b, j - 1)
        bits = F.lit(0).cast("long")
        for t in range(width):
            same = F.coalesce(F.get(a, j - tau + t - 1) == c, F.lit(False))
            bits = bits + F.when(same, F.lit(1 << t).cast("long")).otherwise(F.lit(0).cast("long"))
        return bits

    def step(s: Column, j: Column) -> Column:
        def with_equal(eq: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            d0 = masked((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn))

            def with_d0(d: Column) -> Column:
                hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)))
                hn = d.bitwiseAND(vp)
                half = F.shiftright(d, 1)
                on_path = F.floor(d / F.pow(F.lit(2), shift + tau)).cast("long") % 2
                return F.struct(
                    masked(hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)))).alias("vp"),
                    masked(half.bitwiseAND(hp)).alias("vn"),
                    (s["d"] + F.when((on_path == 0) & (j > -shift), 1).otherwise(0)).alias("d"),
                )

            return let(d0, with_d0)

        return let(equal(j), with_equal)

    start = F.struct(
        F.lit(mask & ~((1 << tau) - 1)).cast("long").alias("vp"),
        F.lit(0).cast("long").alias("vn"),
        F.abs(shift).alias("d"),
    )
    columns = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(
        F.array().cast("array<int>")
    )
    distance = F.aggregate(columns, start, step, lambda s: s["d"])
    return F.when(F.abs(shift) > tau, F.lit(False)).otherwise(distance <= tau)


#: Groups of characters that are counted; the counts of a line are its bag.
GROUPS = ("e", "t", "a", "o", "n", "i", "r", "s", "h", "l", "d", "uw", "bgc", "mpyf", ".", ",", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " ")


def bag(line: Column) -> Column:
    """How many characters of each group a line has."""
    n = F.char_length(line)
    return F.array(*[n - F.char_length(F.translate(line, g, "")) for g in GROUPS])


def bags_near(x: Column, y: Column, tau: int) -> Column:
    """Whether two bags allow ``tau`` edits: an edit changes two counts by one at most."""
    apart = [F.abs(F.get(x, F.lit(k)) - F.get(y, F.lit(k))) for k in range(len(GROUPS))]
    return sum(apart[1:], apart[0]) <= 2 * tau


def verified(pairs: DataFrame, chars: DataFrame, tau: int) -> DataFrame:
    """The pairs (a, b) of line ids within ``tau`` edits; ``chars`` is a stored table
    (id, chars, bag).  Bags that are too far apart spare the computation."""
    both = pairs.join(chars.toDF("a", "_ca", "_ba"), "a").join(chars.toDF("b", "_cb", "_bb"), "b")
    near = bags_near(F.col("_ba"), F.col("_bb"), tau)
    return both.where(F.when(near, within(F.col("_ca"), F.col("_cb"), tau)).otherwise(False)).select("a", "b")


def line_links(docs: DataFrame, tau: int, least_chars: int, id_col: str, text_col: str):
    """(where each line occurs, classes of lines with near duplicates): stored tables
    (doc, text, pos, id) and (node, root)."""
    lines = occurrences(docs, least_chars, id_col, text_col)
    places = stored(lines.select("doc", "text", "pos", "id"))
    often = stored(
        places.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first"))
        .where(F.col("n") >= OFTEN)
        .select("id", "first")
    )
    once = lines.join(F.broadcast(often) if small(often, 64, BYTES) else often, "id", "left").where(
        F.col("first").isNull() | (F.col("first") == F.struct(*PLACE))
    )
    entries = add_keys(once.select("id", "line"), tau)
    bucket = Window.partitionBy("key")
    own = F.when(F.col("own"), F.col("id"))
    found = entries.withColumns(
        {
            "hub": F.min(own).over(bucket),
            "low": F.min("id").over(bucket),
            "high": F.max("id").over(bucket),
        }
    ).where("hub is not null and low < high")
    found = stored(found.select("key", "id", "own", "hub"))
    stars = stored(found.select(F.col("id").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct())
    ids = stored(found.select("id").distinct())
    chars = semi_by_key(lines.select("id", "line"), ids, "id").groupBy("id").agg(F.min("line").alias("line"))
    chars = stored(
        chars.select("id", F.transform(F.split("line", ""), F.ascii).alias("chars"), bag(F.col("line")).alias("bag"))
    )
    links = stored(verified(stars, chars, tau))
    near = components(links).toDF("id", "root")
    near = F.broadcast(near) if small(near, 32, BYTES) else near
    placed = found.join(near, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # buckets of several classes that several indexed lines are in
    open_keys = (
        placed.groupBy("key")
        .agg(F.min("root").alias("l"), F.max("root").alias("h"), F.max(F.when(F.col("own"), F.col("id"))).alias("o"), F.min("hub").alias("hub"))
        .where("l < h and hub < o")
        .select("key")
    )
    placed = placed.join(open_keys, "key").select("key", "id", "own", "root").distinct()
    placed = stored(placed.join(chars.select("id", "bag"), "id"))
    x, y = placed.where("own").alias("x"), placed.alias("y")
    near = bags_near(F.col("x.bag"), F.col("y.bag"), tau)
    pairs = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & near)
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
    )
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(pairs.join(done, ["a", "b"], "left_anti"))
    return places, components(links.union(verified(pairs, chars, tau)))


def dropped_lines(
    docs: DataFrame,
    tau: int = TAU,
    least_chars: int = LEAST_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, text, drop): positions, in order, of each text's lines that repeat an earlier one."""
    places, classes = line_links(docs, tau, least_chars, id_col, text_col)
    classes = classes.toDF("id", "root")
    classes = F.broadcast(classes) if small(classes, 32, BYTES) else classes
    placed = places.join(classes, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = (
        placed.groupBy("root")
        .agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first"))
        .where("n > 1")
        .select("root", "first")
    )
    again = placed.join(first, "root").where(F.struct(*PLACE) != F.col("first"))
    return again.groupBy("doc", "text").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def dedup_lines(
    docs: DataFrame,
    tau: int = TAU,
    least_chars: int = LEAST_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``text_col`` rid of lines that nearly repeat an earlier one, and
    ``n_lines``, ``dropped`` (array of positions) added.

    Lines are compared without white space at their ends, from ``least_chars``
    characters on; shorter ones stay.  Of lines within ``tau`` edits of each
    other, directly or through others, the one of the smallest id, then
    position, stays.  A null text stays null (it has no lines); an empty one
    stays empty.  Rows with a null id stay as they are and take no part.  Rows
    that repeat an id are documents of their own, in order of a hash of their texts; those
    that repeat the text too keep the same lines.  Other columns pass through;
    columns that are named like the added ones are replaced.  An empty table
    gives an empty result.
    """
    drops = stored(dropped_lines(docs, tau, least_chars, id_col, text_col))
    if small(drops, 96, BYTES):
        drops = F.broadcast(drops)
    doc, version, drop = (free_name(docs, f"_drop_{k}") for k in ("doc", "text", "positions"))
    drops = drops.toDF(doc, version, drop)
    joined = docs.drop("n_lines", "dropped").join(
        drops, (F.col(id_col) == F.col(doc)) & (F.xxhash64(text_col) == F.col(version)), "left"
    )
    lines = lines_of(F.col(text_col))
    kept = F.filter(lines, lambda x, i: ~F.array_contains(drop, i))
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumns(
        {
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)),
            "dropped": F.coalesce(drop, F.array().cast("array<int>")),
            text_col: text,
        }
    ).drop(doc, version, drop)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


ORACLE_SQL = rf"""
with recursive l as (
  select doc_id, pos - 1 pos, regexp_replace(line, '^[\s\x00\x0B]+|[\s\x00\x0B]+$', '', 'g') line
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos
        from documents where doc_id is not null)
), o as (select * from l where length(line) >= {LEAST_CHARS}),
d as (select line, length(line) n, row_number() over (order by line) k from (select distinct line from o)),
e as (
  select a.k x, b.k y from d a join d b
  on a.n <= b.n and b.n <= a.n + {TAU} and a.k <> b.k
  where levenshtein(a.line, b.line) <= {TAU}
), s as (select x, y from e union select y, x from e),
r(k, root) as (
  select k, k from d where k in (select x from s)
  union
  select s.y, r.root from r join s on s.x = r.k
), c as (select k, min(root) root from r group by k),
p as (
  select o.doc_id, o.pos, coalesce(c.root, d.k) root
  from o join d using (line) left join c on c.k = d.k
), z as (
  select doc_id, pos, row_number() over (partition by root order by doc_id, pos) nth from p
), g as (
  select doc_id, list(pos order by pos) filter (nth > 1) gone from z group by doc_id
)
select t.doc_id, len(string_split(coalesce(t.text, ''), chr(10)))::bigint n_lines,
  coalesce(len(g.gone), 0)::bigint n_dropped,
  coalesce(array_to_string(g.gone, ','), '') dropped,
  sha256(coalesce(array_to_string(
    [x for x, i in string_split(coalesce(t.text, ''), chr(10)) if not list_contains(coalesce(g.gone, []), i - 1)],
    chr(10)), '')) text_sha256
from documents t left join g using (doc_id)
"""
