"""Document fingerprints from closed syncmers of words and characters, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daygrid.llm.common import written

#: Units of an anchor; its inner substrings are single units, so about 2 of K positions are anchors.
K = 4
#: Characters beyond which a word counts as its characters (a script without blanks has no words), and below which a
#: text is also taken by its characters.
LONG, SHORT = 24, 200
#: Documents of one run of ids that meet in a task, to find their neighbours.
SPAN = 4096
#: Runs up to which the list of their first ids (16 bytes each) is broadcast; a longer one is joined by a shuffle.
FEW = 1_000_000
_LOWEST = -(2**63)


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+`, in the text's order."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " +"), lambda w: w != "")


def pair_hashes(text: Column) -> Column:
    """A 64-bit hash of every character with the one after it (of the last one alone)."""
    c = F.split(text, "")
    return F.zip_with(c, F.slice(c, 2, F.size(c)), lambda x, y: F.xxhash64(x, y))


def word_hashes(words: Column) -> Column:
    """One 64-bit hash per word; of a long word one per character."""
    cut = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, pair_hashes(w)).otherwise(F.array(F.xxhash64(w)))))
    return F.when(F.exists(words, lambda w: F.length(w) > LONG), cut).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def closed_places(h: Column, k: int) -> Column:
    """Where closed syncmers begin: the smallest of the k inner hashes is the first or the last.

    A function of the k units alone, so the same units are an anchor wherever they stand.
    """
    edge = lambda i: F.least(F.element_at(h, i), F.element_at(h, i + (k - 1)))
    closed = F.filter(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.array_min(F.slice(h, i, k)) == edge(i))
    return F.when(F.size(h) >= k, closed).otherwise(F.array().cast("array<int>"))


def anchor_places(h: Column, closed: Column, k: int) -> Column:
    """The closed syncmers; where none is closed the k units with the smallest hash; of fewer units than k the whole.
    Only without units there is no anchor."""
    least = F.array_min(F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.struct(F.xxhash64(F.slice(h, i, k)).alias("h"), i.alias("i"))))["i"]
    return F.when((F.size(closed) > 0) | (F.size(h) == 0), closed).when(F.size(h) >= k, F.array(least)).when(F.size(h) > 0, F.array(F.lit(1)))


def anchors(h: Column, places: Column, k: int) -> Column:
    """A 32-bit hash of the k units of each anchor, in order."""
    return F.transform(places, lambda i: F.xxhash64(F.slice(h, i, k)).bitwiseAND(F.lit(0xFFFFFFFF)))


def as_text(anchor: Column, places: Column, mark: str = "@") -> Column:
    """`hash@unit` of every anchor, with single spaces."""
    return F.array_join(F.zip_with(anchor, places, lambda a, i: F.concat(F.lower(F.lpad(F.hex(a), 8, "0")), F.lit(mark), (i - 1).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors against all, over distinct ones: 2 |A and B| / (|A| + |B|); two empty fingerprints are alike."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def followers(docs: DataFrame, span: int) -> DataFrame:
    """Each row with the text of the next one in descending order of id; the first follows the last.

    Ids are cut into runs of `span`, and a run meets in one task. The first row of a run is also sent to the run
    before it, where it sorts last; to find those, only one id per run is ordered as a whole. Equal ids go by
    descending text, null ids come last.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(_LOWEST))
    rows = docs.withColumn("id", order).withColumn("run", F.floor(order / span)).withColumn("lent", F.lit(False))
    first = rows.groupBy("run").agg(F.max("id").alias("id"))
    down = Window.orderBy(F.col("run").desc())
    borders = first.select("run", F.coalesce(F.lead("id").over(down), F.max("id").over(Window.partitionBy())).alias("id"))
    borders = written(borders, "borders")
    if borders.count() <= FEW:
        borders = F.broadcast(borders)
    lent = rows.drop("run").join(borders, "id").withColumn("lent", F.lit(True)).select(rows.columns)
    each = Window.partitionBy("run").orderBy("lent", F.col("id").desc(), F.col("text").desc())
    following = F.lead("text").over(each)
    return rows.unionByName(lent).withColumn("next", following).where(~F.col("lent")).drop("id", "run", "lent")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, span: int = SPAN) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and their likenesses.

    The edited text's last third is replaced by the first as many code points of the next document (descending id;
    after the last comes the first). Anchors are of words, a long word counting as its characters; a text of few
    characters has those of its characters (`hash@c0`, blanks as single ones) besides, and two such texts are compared
    by these, all others by words. Every text with a word has an anchor. A null text is empty: no anchors, an empty fingerprint. A null id comes last and
    stays null, equal ids go by descending text, repeated rows are kept, an empty table gives no rows, and other
    columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next", F.lit(1), third))
    # texts alone are shuffled: anchors are taken again from what a row has got, rather than moved with it
    each = followers(rows, span).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    for c in ("text", "edited", "next"):
        few = F.length(c) < SHORT
        each = each.withColumn(f"{c}_words", words_of(F.col(c)))
        each = each.withColumns({f"{c}_h": word_hashes(F.col(f"{c}_words")), f"{c}_c": F.when(few & (F.size(f"{c}_words") > 0), pair_hashes(F.array_join(f"{c}_words", " "))).when(few, F.array().cast("array<long>"))})
        each = each.withColumns({f"{c}_{u}_closed": closed_places(F.col(f"{c}_{u}"), k) for u in "hc"})
        each = each.withColumns({f"{c}_{u}_places": anchor_places(F.col(f"{c}_{u}"), F.col(f"{c}_{u}_closed"), k) for u in "hc"})
        each = each.withColumns({f"{c}_{u}_anchors": F.when(F.col(f"{c}_{u}").isNotNull(), anchors(F.col(f"{c}_{u}"), F.col(f"{c}_{u}_places"), k)) for u in "hc"})

    def shown(c: str) -> Column:
        by_word = as_text(F.col(f"{c}_h_anchors"), F.col(f"{c}_h_places"))
        return F.when(F.size(f"{c}_c") > 0, F.concat_ws(" ", by_word, as_text(F.col(f"{c}_c_anchors"), F.col(f"{c}_c_places"), "@c"))).otherwise(by_word)

    def alike(a: str, b: str) -> Column:
        both = F.col(f"{a}_c").isNotNull() & F.col(f"{b}_c").isNotNull()
        return F.when(both, likeness(F.col(f"{a}_c_anchors"), F.col(f"{b}_c_anchors"))).otherwise(likeness(F.col(f"{a}_h_anchors"), F.col(f"{b}_h_anchors")))

    return each.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("text").alias("fingerprint"), shown("edited").alias("edited_fingerprint"),
                       alike("text", "edited").alias("near_edited"), alike("text", "next").alias("near_next"))
