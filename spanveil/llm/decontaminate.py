"""Benchmark decontamination with a distributed positional inverted index. Native DataFrame code only.

Items are cut into phrases (windows of `n` words; a shorter item is one phrase). A phrase's terms are
ranked by their counts over all training words. The index holds postings (term, document, position) of
the terms that are among the two rarest of a phrase, over the whole training text, in the shared folder.

Exact phrases: the rarest term's list, moved by its offset in the phrase, is intersected with the second
rarest's, moved by its own. That leaves few candidates; the lists of the other terms are made for the
documents that hold one, moved by their offsets and intersected too: where all lists meet, the phrase is.
Proximity: the lists of a phrase's terms around each posting of its rarest; all must meet within n + slop
consecutive words.

Every row that shuffles is a posting: no text and no word list travels with it. The phrase and term tables
grow with the benchmark, not with the training text. They are broadcast up to BROADCAST_ROWS rows and
joined by shuffle beyond.

Cases: null text has no words; an item without words has no phrases; repeated rows of a document or
an item count as one match each; rows that share an id but not a text are told apart by the text's
hash; a null item id matches but isn't counted among the items. Empty tables give no hits. Only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import ascii_lower, settled, stage, with_filter

#: What separates words before A-Z are folded. Splitting is over twice as fast as extracting matches.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands after a document's last word, so that its position is the number of words; no word is like it.
END = "\x00"
BROADCAST_ROWS = 100_000


def word_list(text: Column) -> Column:
    """The words, not yet folded: folding word by word leaves all-ASCII ones to the fast path."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def phrases_of(items: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """_item, _key (the words, joined by a space: no word holds one), _words."""
    words = items.select(F.col(item_col).alias("_item"), word_list(ascii_lower(F.col(text_col))).alias("_w")).filter(F.size("_w") > 0)
    starts = words.withColumn("_at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1)))))
    cut = starts.select("_item", F.slice("_w", F.col("_at"), F.lit(n)).alias("_words"))
    return cut.select("_item", F.array_join("_words", " ").alias("_key"), "_words").distinct()


class PhraseIndex:
    """The positional index of docs for the phrases of items."""

    def __init__(self, docs: DataFrame, items: DataFrame, n: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> None:
        self.n, self.slop = n, slop
        self.phrase_items = stage(phrases_of(items, n, item_col, item_text), "decon-phrases")
        phrases = self.phrase_items.select("_key", "_words").distinct()
        self.rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        tokens = self.rows.select(F.explode(word_list(F.col("_t"))).alias("_raw")).select(ascii_lower(F.col("_raw")).alias("_term"))

        offsets = phrases.select("_key", F.posexplode("_words").alias("_off", "_term"))
        self.vocabulary = stage(offsets.select("_term").distinct(), "decon-terms")
        self.n_terms = self.vocabulary.count()
        counts = tokens.join(_side(self.vocabulary, self.n_terms), "_term").groupBy("_term").agg(F.count("*").alias("_count"))
        # Rarest first; a term that the training text lacks rules its phrase out.
        ranked = offsets.join(_side(counts, self.n_terms), "_term", "left").groupBy("_key").agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("_count", F.lit(0)).alias("count"), F.col("_off").alias("off"), F.col("_term").alias("term")))).alias("_by_rarity"), F.count("*").cast("int").alias("_len")
        )
        self.ranked = stage(ranked.filter(F.col("_by_rarity")[0]["count"] > 0), "decon-ranked")
        self.n_ranked = self.ranked.count()
        two = self.ranked.select(F.explode(F.slice("_by_rarity", 1, 2)).alias("x")).select(F.col("x.term").alias("_term")).distinct()
        terms = two.unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("_term")))
        self.postings = stage(self._list(self.rows, terms, 2 * self.n_ranked), "decon-postings")

    @staticmethod
    def _list(rows: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
        """Postings of terms in rows (_id, _t): _term, _id, _h, _pos. END stands at the number of words."""
        words = rows.select("_id", F.xxhash64("_t").alias("_h"), F.posexplode(F.concat(word_list(F.col("_t")), F.array(F.lit(END)))).alias("_pos", "_raw"))
        return words.select(ascii_lower(F.col("_raw")).alias("_term"), "_id", "_h", "_pos").join(_side(terms, n_terms), "_term")

    def documents(self) -> DataFrame:
        """_id, _h, _n (words), a row for each row of docs."""
        return self.postings.filter(F.col("_term") == END).select("_id", "_h", F.col("_pos").cast("long").alias("_n"))

    def _rank(self, k: int) -> DataFrame:
        """Of each phrase: _key, _len and the k-th rarest term with its offset, none if the phrase is shorter."""
        return self.ranked.filter(F.col("_len") > k).select("_key", "_len", F.col("_by_rarity")[k]["term"].alias("_term"), F.col("_by_rarity")[k]["off"].alias("_off"))

    def _lists_of(self, found: DataFrame) -> DataFrame:
        """Postings of all phrases' terms in the documents that found names (_h)."""
        held = with_filter(self.rows.withColumn("_h", F.xxhash64("_t")), found, ["_h"]).filter("_maybe").select("_id", "_t")
        return self._list(held, self.vocabulary, self.n_terms)

    @staticmethod
    def _meet(wanted: DataFrame, lists: DataFrame) -> DataFrame:
        """Rows of wanted (_term, _id, _h, _pos, ...) that lists have a posting for."""
        place = lists.select(F.col("_term").alias("t"), F.col("_h").alias("h"), F.col("_pos").alias("p"), F.col("_id").alias("i"))
        return wanted.join(place, (F.col("_term") == F.col("t")) & (F.col("_h") == F.col("h")) & (F.col("_pos") == F.col("p")) & F.col("_id").eqNullSafe(F.col("i")), "left_semi")

    def exact(self) -> DataFrame:
        """_id, _h, _key, _start, _end (exclusive) of every occurrence of a phrase."""
        first, second = self._rank(0), self._rank(1).select("_key", F.col("_term").alias("_term2"), F.col("_off").alias("_off2"))
        begun = self.postings.join(_side(first, self.n_ranked), "_term").select("_id", "_h", "_key", "_len", (F.col("_pos") - F.col("_off")).alias("_start")).filter("_start >= 0").distinct()
        both = begun.join(_side(second, self.n_ranked), "_key", "left")
        place = ["_id", "_h", "_key", "_len", "_start"]
        alone = both.filter("_term2 is null").select(*place)
        met = self._meet(both.filter("_term2 is not null").select(*place, F.col("_term2").alias("_term"), (F.col("_start") + F.col("_off2")).alias("_pos")), self.postings).select(*place)
        found = stage(alone.unionByName(met), "decon-candidates")
        others = self.ranked.select("_key", F.explode(F.slice("_by_rarity", F.lit(3), F.greatest(F.col("_len") - 2, F.lit(0)))).alias("x")).select("_key", F.col("x.term").alias("_term"), F.col("x.off").alias("_off"))
        wanted = found.filter("_len > 2").join(_side(others, self.n_ranked * self.n), "_key").select(*place, "_term", (F.col("_start") + F.col("_off")).alias("_pos"))
        whole = self._meet(wanted, self._lists_of(found.filter("_len > 2"))).groupBy(*place).agg(F.count("*").alias("_met")).filter("_met = _len - 2").select(*place)
        return found.filter("_len <= 2").unionByName(whole).select("_id", "_h", "_key", "_start", (F.col("_start") + F.col("_len")).alias("_end"))

    def near(self) -> DataFrame:
        """_id, _h, _key, _pos of a phrase's rarest term: all words of the phrase are within its length plus slop words there."""
        span = F.col("_len") + self.slop
        anchors = stage(self.postings.join(_side(self._rank(0), self.n_ranked), "_term").select("_id", "_h", "_key", "_len", F.col("_pos").alias("_at")).distinct(), "decon-anchors")
        around = anchors.select("*", F.explode(F.sequence(F.greatest(F.col("_at") - span + 1, F.lit(0)), F.col("_at") + span - 1)).alias("_pos"))
        lists = self._lists_of(anchors).distinct()
        same = [around["_h"] == lists["_h"], around["_pos"] == lists["_pos"], around["_id"].eqNullSafe(lists["_id"])]
        met = around.join(lists, same).select(around["_id"], around["_h"], "_key", "_len", "_at", around["_pos"], "_term")
        # At most 2 (n + slop) words stand around a posting.
        words = met.groupBy("_id", "_h", "_key", "_len", "_at").agg(F.collect_list(F.struct(F.col("_pos").alias("pos"), F.col("_term").alias("term"))).alias("_ws"))

        def holds(s: Column) -> Column:
            there = F.transform(F.filter("_ws", lambda w: (w["pos"] >= s) & (w["pos"] < s + span)), lambda w: w["term"])
            return F.size(F.array_except(F.split("_key", " "), there)) == 0

        inside = F.exists(F.sequence(F.greatest(F.col("_at") - span + 1, F.lit(0)), F.col("_at")), holds)
        return words.filter(inside).select("_id", "_h", "_key", F.col("_at").alias("_pos"))


@settled
def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each of docs: id_col, n_words, n_hit, items (sorted item ids as strings), spans (array of struct(start, end) in words), contaminated."""
    index = PhraseIndex(docs, items, n, 0, id_col, text_col, item_col, item_text)
    hits = stage(index.exact(), "decon-hits")
    doc = ["_id", "_h"]
    before = Window.partitionBy(*doc).orderBy("_start", "_end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select(*doc, "_start", "_end").distinct().withColumn("_seen", F.coalesce(F.max("_end").over(before), F.col("_start")))
    covered = spans.groupBy(*doc).agg(
        F.sum(F.greatest(F.lit(0), F.col("_end") - F.greatest("_start", "_seen"))).alias("_hit"), F.array_sort(F.collect_list(F.struct(F.col("_start").alias("start"), F.col("_end").alias("end")))).alias("_spans")
    )
    of = index.phrase_items.select("_key", F.col("_item").cast("string").alias("_item"))
    named = hits.select(*doc, "_key").distinct().join(_side(of, index.phrase_items.count()), "_key").groupBy(*doc).agg(F.array_sort(F.collect_set("_item")).alias("_items"))
    found = covered.join(named, [covered["_id"].eqNullSafe(named["_id"]), covered["_h"] == named["_h"]]).select(covered["_id"].alias("_id"), covered["_h"].alias("_h"), "_hit", "_spans", "_items")
    rows = index.documents()
    out = rows.join(found, [rows["_id"].eqNullSafe(found["_id"]), rows["_h"] == found["_h"]], "left")
    hit = F.coalesce("_hit", F.lit(0)).cast("long")
    return out.select(
        rows["_id"].alias(id_col), F.col("_n").alias("n_words"), hit.alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("_spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), (hit > 0).alias("contaminated"),
    )
