"""The greedy topic merge of large rooms in rounds of joins, equal to the walk topic by topic.

In the walk a topic, in the order of its room, goes into the first kept topic that is similar enough, and that one
gains its keywords. Where a topic goes depends only on where earlier ones went. So all topics of a wave are decided
at once, as if the last answer were right for those before them; what comes out is the next answer. The first
topic whose answer is wrong is right in the next round, and an answer that repeats itself is that of the walk.

* Waves double in size, so most of a later wave meets kept topics that no longer change, and topics that find
  none among these start out as kept themselves.
* Only topics that share a matching word are compared; the pairs of matching words come from a similarity join.
* A kept topic is known to a later one by its words with the place at which it gained each of them, so no state
  is copied: what it held at a time is a filter on places.

Nothing is gathered per room. Per pair of topics only the matching words meet.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.topics import plain_keywords
from chatlake.operators.skew import number_rows
from chatlake.operators.wordmatch import matching_words
from chatlake.session import cut_lineage

#: Topics of a room in the first wave.
FIRST_WAVE = 1000

ASSIGNED = "chatroom string, topic_no long, kept_no long, step long, similarity double, log string"


def shown(words: list[str]) -> str:
    return "[" + ", ".join(words[:5]) + (", ...]" if len(words) > 5 else "]")


def log_line(kept: list[str], words: list[str], share: float) -> str:
    return f"merge={shown(kept)} <- {shown(words)}; keyword_sim={share:.2f}; reason=keyword_similarity"


def _plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        normal = [(plain_keywords([word]) or [None])[0] for word in batch["word"]]
        yield batch.assign(plain=normal).dropna(subset=["plain"])


def topic_words(placed: DataFrame) -> DataFrame:
    """chatroom, p, i, word, plain: the keywords of each topic that have letters, and their normalised form."""
    rows = placed.select("chatroom", "p", F.posexplode("keywords").alias("i", "word")).where(F.length("word") > 0)
    return rows.mapInPandas(_plain, "chatroom string, p long, i int, word string, plain string")


def _greedy(pairs: Column) -> Column:
    """How many words find a partner, one after the other, where each takes the first free one that matches."""
    empty = F.array().cast("array<int>")
    start = F.struct(F.lit(None).cast("struct<word:string,i:int>").alias("last"), empty.alias("taken"))

    def step(acc: Column, pair: Column) -> Column:
        done = acc["last"].eqNullSafe(pair["at"]) | F.array_contains(acc["taken"], pair["j"])
        return F.struct(
            F.when(done, acc["last"]).otherwise(pair["at"]).alias("last"),
            F.when(done, acc["taken"]).otherwise(F.array_append(acc["taken"], pair["j"])).alias("taken"),
        )

    return F.aggregate(F.array_sort(pairs), start, step, lambda acc: F.size(acc["taken"]))


def _decide(
    answer: DataFrame, words: DataFrame, counts: DataFrame, wanted: DataFrame, low: int, high: int, threshold: float
) -> DataFrame:
    """chatroom, p, k, similarity of the topics from ``low`` to ``high``, if ``answer`` holds for those before.

    ``answer`` has chatroom, p, k; a topic it does not have is not there yet.
    """
    members = answer.join(words, ["chatroom", "p"])
    grown = answer.where("p != k").groupBy("chatroom", "k").agg(F.min("p").alias("grown"))
    gained = members.groupBy("chatroom", "k", "word", "plain").agg(F.min("p").alias("since"))
    sizes = gained.groupBy("chatroom", "k").agg(
        F.count(F.when(F.col("since") < low, 1)).alias("base"),
        F.collect_list(F.when(F.col("since") >= low, F.col("since"))).alias("later"),
    )
    kept = (
        answer.where("p = k").select("chatroom", "k")
        .join(counts.select("chatroom", F.col("p").alias("k"), F.col("n").alias("own")), ["chatroom", "k"])
        .join(grown, ["chatroom", "k"], "left")
        .join(sizes, ["chatroom", "k"], "left")
    )
    # its own list in its order until it gains words, from then on all words in theirs
    alone = members.where("p = k").select(
        "chatroom", "k", "plain", F.struct(F.lit("").alias("word"), F.col("i")).alias("at"), F.lit(None).cast("long").alias("since")
    )
    together = gained.select("chatroom", "k", "plain", F.struct("word", F.lit(0).alias("i")).alias("at"), "since")
    held = alone.unionByName(together).join(grown, ["chatroom", "k"], "left")
    held = held.where(F.col("since").isNull() | F.col("grown").isNotNull())
    before = (F.col("k") < F.col("p")) & F.when(
        F.col("since").isNull(), F.col("grown").isNull() | (F.col("grown") >= F.col("p"))
    ).otherwise((F.col("grown") < F.col("p")) & (F.col("since") < F.col("p")))
    meeting = (
        wanted.where(F.col("p").between(low, high))
        .join(held, ["chatroom", "plain"])
        .where(before)
        .groupBy("chatroom", "p", "k")
        .agg(F.collect_list(F.struct("at", "j")).alias("pairs"))
        .select("chatroom", "p", "k", _greedy(F.col("pairs")).alias("matched"))
    )
    has_grown = F.coalesce(F.col("grown") < F.col("p"), F.lit(False))
    size = F.when(has_grown, F.col("base") + F.size(F.filter("later", lambda s: s < F.col("p")))).otherwise(F.col("own"))
    share = F.col("matched") / F.greatest(size, F.col("n"))
    fitting = (
        meeting.join(kept, ["chatroom", "k"])
        .join(counts.select("chatroom", "p", "n"), ["chatroom", "p"])
        .select("chatroom", "p", "k", share.alias("similarity"))
        .where(F.col("similarity") >= threshold)
        .groupBy("chatroom", "p")
        .agg(F.min(F.struct("k", "similarity")).alias("best"))
    )
    return (
        counts.where(F.col("p").between(low, high))
        .select("chatroom", "p")
        .join(fitting, ["chatroom", "p"], "left")
        .select("chatroom", "p", F.coalesce("best.k", "p").alias("k"), "best.similarity")
    )


def assign_in_rounds(topics: DataFrame, threshold: float, first_wave: int = FIRST_WAVE) -> DataFrame:
    """The kept topic of each topic, the merge's number within it, similarity and log line.

    Topics have chatroom, topic_no, message_count and keywords; the threshold is positive.
    """
    order = F.coalesce(-F.col("message_count"), F.lit(1 << 62))
    placed = cut_lineage(
        number_rows(
            topics.select("chatroom", "topic_no", "keywords", order.alias("_less")), ["chatroom"], ["_less", "topic_no"], "p"
        ).select("chatroom", "topic_no", "keywords", F.col("p").cast("long").alias("p"))
    )
    words = cut_lineage(topic_words(placed))
    counts = cut_lineage(
        placed.select("chatroom", "p")
        .join(words.groupBy("chatroom", "p").agg(F.count(F.lit(1)).alias("n")), ["chatroom", "p"], "left")
        .select("chatroom", "p", F.coalesce("n", F.lit(0)).alias("n"))
    )
    pairs = matching_words(words.select("chatroom", F.col("plain").alias("word")), ["chatroom"])
    # for each word of a topic, by its place j, the words of kept topics that it matches
    wanted = cut_lineage(
        words.select("chatroom", "p", F.col("i").alias("j"), F.col("plain").alias("second"))
        .join(pairs, ["chatroom", "second"])
        .select("chatroom", "p", "j", F.col("first").alias("plain"))
    )
    last = counts.agg(F.max("p")).first()[0] or 0
    settled = counts.limit(0).select("chatroom", "p", F.col("p").alias("k"), F.lit(None).cast("double").alias("similarity"))
    low, size = 1, first_wave
    while low <= last:
        high = low + size - 1
        settled = _wave(settled, words, counts, wanted, low, high, threshold)
        low, size = high + 1, 2 * size
    return _with_steps(placed, settled)


def _wave(
    settled: DataFrame, words: DataFrame, counts: DataFrame, wanted: DataFrame, low: int, high: int, threshold: float
) -> DataFrame:
    # first without the wave itself; topics that find nothing are kept, until another round says otherwise
    decide = lambda answer: cut_lineage(_decide(answer, words, counts, wanted, low, high, threshold))
    earlier = settled.select("chatroom", "p", "k")
    now = decide(earlier)
    while True:
        then = decide(earlier.unionByName(now.select("chatroom", "p", "k")))
        changed = then.select("chatroom", "p", "k").join(now.select("chatroom", "p", "k"), ["chatroom", "p", "k"], "left_anti")
        now = then
        if changed.isEmpty():
            return cut_lineage(settled.unionByName(now))


def _with_steps(placed: DataFrame, settled: DataFrame) -> DataFrame:
    """Numbers and log lines of the merges, from one pass over the members of each kept topic in order."""
    numbers = placed.select("chatroom", F.col("p").alias("k"), F.col("topic_no").alias("kept_no"))
    rows = placed.join(settled, ["chatroom", "p"]).join(numbers, ["chatroom", "k"])
    ordered = rows.select("chatroom", "k", "p", "topic_no", "kept_no", "keywords", "similarity")
    ordered = ordered.repartition("chatroom", "k").sortWithinPartitions("chatroom", "k", "p")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, steps, own, held, seen = None, 0, [], [], set()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                new = [] if row.keywords is None else list(row.keywords)
                if (row.chatroom, row.k) != current:
                    current, steps, own, held, seen = (row.chatroom, row.k), 0, new, sorted({*new}), {*new}
                    out.append((row.chatroom, row.topic_no, row.kept_no, 0, None, None))
                    continue
                line = log_line(held if steps else own, new, row.similarity)
                steps += 1
                for word in {*new} - seen:
                    seen.add(word)
                    bisect.insort(held, word)
                out.append((row.chatroom, row.topic_no, row.kept_no, steps, row.similarity, line))
            yield pd.DataFrame(out, columns=[part.split()[0] for part in ASSIGNED.split(", ")])

    return ordered.mapInPandas(walk, ASSIGNED)
