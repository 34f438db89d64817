"""Passages of held-out test items inside a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.words import sequence_hashes, words_of
from casewright.plans.session import cut

#: Bytes that the distinct windows of all items may take as a broadcast table (a window is counted with its text and
#: ``ROW`` bytes for hash, offset and the table's own); beyond, joins shuffle.
BROADCAST_BYTES, ROW = 32 << 20, 128


def leaked_items(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 12, shingle: int = 3
) -> DataFrame:
    """Pairs of a document and an item that share at least ``run`` consecutive words: columns ``doc_id``, ``item_id``.

    A containment join with prefix filter. Each item is the set of its windows of ``run`` words; a document leaks a
    window when it contains it wholly, so it must contain the window's rarest shingle (rarity counted over the whole
    corpus), which is the window's prefix token. Candidates are (document, window start), bounded by position (the
    start that the token's place implies is not before the text) and by length (the window ends inside it), then
    the words of that window-sized part are compared exactly.

    The items' windows are counted in bytes. Up to ``BROADCAST_BYTES`` their shingles and then their prefix tokens are
    broadcast: one pass over the documents counts the shingles of the items (combined in each task), a second meets
    the prefix tokens and compares windows where it stands, so no document and no position is shuffled. Beyond, the
    places of the items' shingles are joined by shuffles, and only documents with candidates are read again. An item that
    a third of the corpus quotes gives that many candidates, spread over the scan's partitions.

    Nulls: null texts and null ids on either side take no part. Texts of fewer than ``run`` words never match. Rows
    repeated on either side give one pair. Empty tables give an empty result. Other columns are not read.
    """
    if not 1 <= shingle <= run:
        raise ValueError("shingle must be between 1 and run")
    item = items.select(F.col(item_id).alias("_item"), words_of(F.col(item_text)).alias("_w")).where("_item IS NOT NULL")
    windows = F.transform(F.array("_w"), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (run - 1)), lambda k: F.slice(w, k, run)))[0]
    window = cut(item.where(F.size("_w") >= run).select("_item", F.explode(windows).alias("_win")).distinct())
    distinct = window.select("_win").distinct()
    size = distinct.agg(F.sum(F.length(F.array_join("_win", " ")) + ROW)).first()[0] or 0
    small = size <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda d: d.hint("merge"))
    tokens = distinct.select(F.array_join("_win", " ").alias("_win"), F.posexplode(sequence_hashes(F.col("_win"), shingle)).alias("_off", "_h"))

    # no filter by number of words here: it would split every text twice
    text_ = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_doc"), F.col(text).alias("_t"))
    words = text_.select("_doc", words_of(F.col("_t")).alias("_w"))
    seen = words.select("_doc", F.size("_w").alias("_n"), F.posexplode(sequence_hashes(F.col("_w"), shingle)).alias("_pos", "_h"))
    hits = seen.join(hint(tokens.select("_h").distinct()), "_h")
    if not small:
        hits = cut(hits)

    rarity = hits.groupBy("_h").agg(F.count("*").alias("_count"))
    ranked = tokens.join(rarity.hint("merge"), "_h").select("_win", F.struct(F.col("_count").alias("c"), "_h", "_off").alias("_t"))
    whole = tokens.groupBy("_win").agg(F.count("*").alias("_all"))  # a window with a shingle that no document has leaks nowhere
    prefix = ranked.groupBy("_win").agg(F.min("_t").alias("_t"), F.count("*").alias("_some")).join(whole.hint("merge"), "_win").where("_some = _all")
    prefix = cut(prefix.select("_win", F.col("_t._h").alias("_h"), F.col("_t._off").alias("_off")))
    start = F.col("_pos") - F.col("_off")
    inside = (F.col("_pos") >= F.col("_off")) & (start + run <= F.col("_n"))
    same = F.array_join(F.slice("_w", F.col("_start") + 1, run), " ") == F.col("_win")
    if small:
        places = words.select("_doc", "_w", F.size("_w").alias("_n"), F.posexplode(sequence_hashes(F.col("_w"), shingle)).alias("_pos", "_h"))
        true = places.join(hint(prefix), "_h").where(inside).select("_doc", "_w", start.alias("_start"), "_win").where(same)
    else:
        found = cut(hits.join(hint(prefix), "_h").where(inside).select("_doc", start.alias("_start"), "_win").distinct())
        some = text_.join(found.select("_doc").distinct().hint("merge"), "_doc", "left_semi").select("_doc", words_of(F.col("_t")).alias("_w"))
        true = some.join(found.hint("merge"), "_doc").where(same)
    named = window.select("_item", F.array_join("_win", " ").alias("_win"))
    return true.select("_doc", "_win").join(hint(named), "_win").select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id)).distinct()
