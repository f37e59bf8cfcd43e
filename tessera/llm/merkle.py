"""Document fingerprints (native): a Merkle tree over paragraphs and sections; DataFrame functions only.

A leaf is a run of words of a paragraph (a line). A word with the blanks behind it ends a leaf where a number made of
its first two code points and its length has the remainder 0; inside a word of more than LONG code points, as in
scripts without blanks, two neighbouring code points decide alike. A leaf of more than LEAF code points is cut at that
length. A paragraph hashes its leaves, a section hashes its paragraphs, the root hashes its sections. A section ends
behind each paragraph whose hash starts with one of four hex digits. So all boundaries follow content, in any script,
and an edit moves those around it only. Roots test equality; branches that differ locate an edit (``diff``).

A fingerprint is the root and a sketch: the SKETCH smallest distinct leaf hashes, which estimate the Jaccard
likeness of two trees' leaves without keeping all of them; ``exact_likeness`` compares all leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Most code points of a leaf, and of a word that is not looked into; one in WORDS words and in PAIRS pairs of code
#: points ends a leaf.
LEAF, LONG, WORDS, PAIRS = 96, 24, 5, 17
#: What marks an end, and stays with its leaf; in a text it is an end, too, and makes another leaf than the mark alone.
END = "\\u0001"
SKETCH = 128
#: Range buckets of the neighbour search: at most so many, of about so many documents.
BUCKETS, BUCKET_DOCS = 65_536, 100_000
NO_ID = -(2**63)


def _cut(paragraph: str) -> str:
    """SQL of the leaves of a paragraph, in order, with the marks behind them."""
    inside = f"array_join(zip_with(split(w, ''), concat(array(''), split(w, '')), (c, b) -> if((ascii(c) * 31 + ascii(b)) % {PAIRS} = 0, concat(c, '{END}'), coalesce(c, ''))), '')"
    ends = f"(ascii(w) * 31 + ascii(substr(w, 2, 1)) * 7 + length(w)) % {WORDS} = 0"
    words = f"transform(regexp_extract_all({paragraph}, '[^ ]+ *| +', 0), w -> if(length(w) > {LONG}, {inside}, if({ends}, concat(w, '{END}'), w)))"
    return f"regexp_extract_all(array_join({words}, ''), '[^{END}]{{1,{LEAF}}}{END}*|{END}+', 0)"


def _leaves(text: str) -> str:
    return f"transform(split({text}, '\\n', -1), p -> transform({_cut('p')}, l -> md5(cast(l as binary))))"


def leaves(text: str) -> Column:
    """Hashes of the leaves of each paragraph, of the column named text."""
    return F.expr(_leaves(text))


def paragraphs(tree: str) -> Column:
    return F.expr(f"transform({tree}, l -> md5(cast(array_join(l, '') as binary)))")


def sections(nodes: str) -> Column:
    """Hashes of the sections, of a column of paragraph hashes."""
    marked = f"array_join(transform({nodes}, h -> concat(h, if(substr(h, 1, 1) < '4', ';', ','))), '')"
    return F.expr(f"transform(split({marked}, ';', -1), s -> md5(cast(s as binary)))")


def root(nodes: Column) -> Column:
    return F.md5(F.array_join(nodes, "").cast("binary"))


def sketch(tree: str, size: int = SKETCH) -> Column:
    return F.expr(f"slice(sort_array(array_distinct(transform(flatten({tree}), x -> substr(x, 1, 8)))), 1, {size})")


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with {prefix}root and {prefix}sketch of the column text."""
    return (
        df.withColumn(f"{prefix}leaves", leaves(text))
        .withColumn(f"{prefix}root", root(sections_of(f"{prefix}leaves")))
        .withColumn(f"{prefix}sketch", sketch(f"{prefix}leaves"))
        .drop(f"{prefix}leaves")
    )


def sections_of(tree: str) -> Column:
    return sections(f"transform({tree}, l -> md5(cast(array_join(l, '') as binary)))")


def fingerprint(root_hash: str, sketch_of: str) -> Column:
    return F.concat(F.col(root_hash), F.lit(":"), F.array_join(F.col(sketch_of), ""))


def likeness(root_a: str, sketch_a: str, root_b: str, sketch_b: str, size: int = SKETCH) -> Column:
    """1 for equal roots; else the share of common hashes among the smallest of both sketches."""
    union = f"slice(sort_array(array_union({sketch_a}, {sketch_b})), 1, {size})"
    common = f"size(array_intersect({union}, array_intersect({sketch_a}, {sketch_b}))) / size({union})"
    return F.expr(f"if({root_a} = {root_b}, 1.0D, if(size({sketch_a}) + size({sketch_b}) = 0, 0.0D, {common}))")


def exact_likeness(a: str, b: str) -> Column:
    """The share of common distinct leaves of two columns of leaves; 1 where neither has any."""
    a, b = f"flatten({a})", f"flatten({b})"
    return F.expr(f"if(size({a}) + size({b}) = 0, 1.0D, size(array_intersect({a}, {b})) / size(array_union({a}, {b})))")


def _changes(nodes: DataFrame, by: str) -> DataFrame:
    """(by, a_pos, b_pos, change) of nodes (by, side, pos, h): the k-th node of a hash in a stands for the k-th in b.

    change: removed, added, moved (b holds something of a later place before it) or null.
    """
    a, b = F.col("side") == "a", F.col("side") == "b"
    nth = F.row_number().over(Window.partitionBy(by, "side", "h").orderBy("pos"))
    pairs = nodes.withColumn("nth", nth).groupBy(by, "h", "nth").agg(F.max(F.when(a, F.col("pos"))).alias("a_pos"), F.max(F.when(b, F.col("pos"))).alias("b_pos"))
    before = F.max("a_pos").over(Window.partitionBy(by).orderBy(F.col("b_pos").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    change = F.when(F.col("b_pos").isNull(), "removed").when(F.col("a_pos").isNull(), "added").when(F.col("before") > F.col("a_pos"), "moved")
    return pairs.withColumn("before", before).select(by, "a_pos", "b_pos", change.alias("change"))


def diff(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """What turns text a into text b: (by, level, change, a_pos, b_pos), positions from 0.

    by names a column that tells pairs apart. Pairs of equal roots have no rows. Sections that both have are not looked
    into; those at another place are moved sections. The paragraphs of the other sections are removed, added or moved.
    A null text is empty. Work is linear in the paragraphs but for sorting those of one text.
    """
    tree = lambda text: paragraphs(_leaves(text))
    both = pairs.select(by, F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")).select(by, tree("a").alias("a"), tree("b").alias("b"))
    both = both.where(root(sections("a")) != root(sections("b")))
    sides = both.select(by, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("p")), F.struct(F.lit("b").alias("side"), F.col("b").alias("p")))).alias("t"))
    nodes = sides.select(by, "t.side", F.posexplode("t.p").alias("pos", "h"))
    above = Window.partitionBy(by, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("section", F.coalesce(F.sum((F.substring("h", 1, 1) < "4").cast("int")).over(above), F.lit(0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), "")
    tops = _changes(nodes.groupBy(by, "side", F.col("section").alias("pos")).agg(F.md5(joined.cast("binary")).alias("h")), by)
    apart = tops.where("change = 'removed'").select(by, F.lit("a").alias("side"), F.col("a_pos").alias("section")).unionAll(tops.where("change = 'added'").select(by, F.lit("b").alias("side"), F.col("b_pos").alias("section")))
    inner = _changes(nodes.join(apart, [by, "side", "section"]).select(by, "side", "pos", "h"), by).where("change is not null")
    out = inner.withColumn("level", F.lit("paragraph")).unionByName(tops.where("change = 'moved'").withColumn("level", F.lit("section")))
    return out.select(by, "level", "change", F.col("a_pos").cast("int").alias("a_pos"), F.col("b_pos").cast("int").alias("b_pos"))


def _neighbours(docs: DataFrame) -> DataFrame:
    """docs (id, text, tie) with root and sketch, and next: text, root and sketch of the next document by descending id.

    Ids fall into ranges of about equal counts (bounds from a quantile sketch), and a window runs in each range.
    The greatest id below a range joins it as a guest, so the last of a range finds its neighbour; the guest of the
    lowest range is the greatest of all. Texts are dealt once; bounds and guests are at most BUCKETS.
    """
    spark = docs.sparkSession
    total = docs.count()
    buckets = max(1, min(BUCKETS, max(4 * partitions(spark), total // BUCKET_DOCS)))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(docs.agg(F.percentile_approx("id", shares, 20 * buckets).alias("b")).first()["b"] or [])) if shares and total else []
    if bounds:
        steps = [2**k for k in range(len(bounds).bit_length() - 1, -1, -1)]
        docs = docs.withColumn("_bounds", F.array(*[F.lit(b).cast("long") for b in bounds]))
        docs = docs.withColumn("range", F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (at, s) -> if(at + s <= {len(bounds)} and _bounds[least(at + s, {len(bounds)}) - 1] <= id, at + s, at))")).drop("_bounds")
    else:
        docs = docs.withColumn("range", F.lit(0))
    heads = docs.groupBy("range").agg(F.max("id").alias("head"))  # a row for each range
    order = Window.orderBy("range")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guests = heads.select("range", F.coalesce(F.lag("head").over(order), F.last("head").over(every)).alias("guest"))
    visiting = docs.drop("range").join(F.broadcast(guests), F.col("id") == F.col("guest")).drop("guest").withColumn("visits", F.lit(1))
    both = with_tree(docs.withColumn("visits", F.lit(0)).unionByName(visiting), "text", "")  # trees of guests are few
    near = Window.partitionBy("range").orderBy("visits", F.col("id").desc(), "tie")
    return both.withColumn("next", F.lead(F.struct("text", "root", "sketch")).over(near)).where("visits = 0")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    A null text is empty. Null doc_ids come behind all others. Rows that share a doc_id follow one another by a hash
    of their text. A single document is its own neighbour. Rows of null or of one repeated doc_id are in one range.
    Likeness is exact for texts of up to SKETCH distinct leaves together, else an estimate (standard error below 0.05).
    Other columns play no part; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("tie", F.xxhash64("text"))
    out = _neighbours(slim).withColumn("n_chars", F.length("text").cast("long"))
    out = out.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next.text, 1, cast(n_chars div 3 as int)))"))
    out = out.withColumn("next_root", F.col("next.root")).withColumn("next_sketch", F.col("next.sketch")).drop("text", "next")
    out = out.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    out = with_tree(out, "edited", "e_")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("root", "sketch").alias("fingerprint"), fingerprint("e_root", "e_sketch").alias("edited_fingerprint"),
        likeness("root", "sketch", "e_root", "e_sketch").alias("near_edited"), likeness("root", "sketch", "next_root", "next_sketch").alias("near_next"),
    )


def op2_merkle(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _tree_sql(text: str) -> str:
    at = lambda i: f"unicode(substr(w, {i}, 1))"
    inside = f"array_to_string(list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1) || CASE WHEN ({at('i')} * 31 + CASE WHEN i > 1 THEN {at('i - 1')} ELSE 0 END) % {PAIRS} = 0 THEN chr(1) ELSE '' END), '')"
    ends = f"({at(1)} * 31 + CASE WHEN length(w) > 1 THEN {at(2)} ELSE 0 END * 7 + length(w)) % {WORDS} = 0"
    words = f"list_transform(regexp_extract_all(p, '[^ ]+ *| +'), lambda w: CASE WHEN length(w) > {LONG} THEN {inside} WHEN {ends} THEN w || chr(1) ELSE w END)"
    tree = f"list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(array_to_string({words}, ''), '[^\\x01]{{1,{LEAF}}}\\x01*|\\x01+'), lambda c: md5(c)))"
    return f"""SELECT *, list_transform(tree, lambda l: md5(array_to_string(l, ''))) AS paras,
      list_sort(list_distinct(list_transform(flatten(tree), lambda x: substr(x, 1, 8))))[1:{SKETCH}] AS sketch
      FROM (SELECT *, {tree} AS tree FROM (SELECT *, {text} AS body FROM src))"""


OP2_SQL = rf"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
nx AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
       FROM o WINDOW w AS (ORDER BY doc_id DESC)),
src AS (SELECT doc_id, 0 AS edited, next_id, n, text AS t FROM nx
        UNION ALL SELECT doc_id, 1, next_id, n, substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) FROM nx),
tree AS ({_tree_sql("t")}),
f AS (SELECT doc_id, edited, next_id, n, body,
        md5(array_to_string(list_transform(string_split(array_to_string(list_transform(paras, lambda h: h || CASE WHEN substr(h, 1, 1) < '4' THEN ';' ELSE ',' END), ''), ';'), lambda s: md5(s)), '')) AS root, sketch
      FROM tree),
p AS (SELECT a.doc_id, a.n, a.root, a.sketch, e.root AS e_root, e.sketch AS e_sketch, sha256(e.body) AS edited_sha256, b.root AS n_root, b.sketch AS n_sketch
      FROM f a JOIN f e ON a.doc_id = e.doc_id AND e.edited = 1 JOIN f b ON a.next_id = b.doc_id AND b.edited = 0 WHERE a.edited = 0),
u AS (SELECT *, list_sort(list_distinct(list_concat(sketch, e_sketch)))[1:{SKETCH}] AS ue, list_sort(list_distinct(list_concat(sketch, n_sketch)))[1:{SKETCH}] AS un FROM p)
SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, root || ':' || array_to_string(sketch, '') AS fingerprint, e_root || ':' || array_to_string(e_sketch, '') AS edited_fingerprint,
  CASE WHEN root = e_root THEN 1.0 WHEN len(ue) = 0 THEN 0.0 ELSE len(list_intersect(ue, list_intersect(sketch, e_sketch)))::DOUBLE / len(ue) END::DOUBLE AS near_edited,
  CASE WHEN root = n_root THEN 1.0 WHEN len(un) = 0 THEN 0.0 ELSE len(list_intersect(un, list_intersect(sketch, n_sketch)))::DOUBLE / len(un) END::DOUBLE AS near_next
FROM u
"""
