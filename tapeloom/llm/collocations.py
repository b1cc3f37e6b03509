"""Phrase collocations: suffix arrays of word ids by shard, n-gram counts from their LCP intervals, merged by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.llm.common import slices, table, text_of
from tapeloom.storage import cut

MOST_WORDS = 5
LEAST = 100
TOP = 2000

#: Words of one suffix array at most, all languages together; a shard's memory is some 100 bytes a word.
SHARD_WORDS = 1 << 20
#: Bytes of a text that are split into words at a time, to the end of a piece.
TEXT_BYTES = 1 << 20
#: Rows of a result batch.
BATCH_ROWS = 1 << 15
#: Bits of a filter at most (8 MiB); a full one only lets more through.
MOST_BITS = 1 << 26
#: Bits of the filter of words for each frequent one.
FILTER_BITS = 128
#: Buckets of pairs and of triples, for each phrase that can be frequent: a bucket holds a 32nd of the least count of one, on average.
BUCKETS = 32
#: The seed is that of Spark's xxhash64; the factor mixes the hashes of words.
SEED, MIX = 42, 0x9E3779B97F4A7C15
#: Phrases of a language that one task ranks, roughly; more are ranked in parts first.
RANK_ROWS = 20_000

#: What ends a piece: a byte that no UTF-8 text holds.
END = b"\xff"
#: A-Z lower-cased, the ends of pieces marked.
_MAP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + END * 10)


def suffix_array(ids, depth: int):
    """The positions of ``ids`` sorted by the ``depth`` ids from there on, and how many of these each has in common with the one before.

    Prefix doubling: ranks by h ids, paired with the rank h ids further on,
    give ranks by twice as many; the last step is shorter where ``depth`` is
    no power of two. What lies beyond the end counts as id 0.
    """
    import numpy as np

    n = len(ids)
    rank, h = ids.astype(np.int64), 1
    order = np.argsort(rank) if depth == 1 else None
    while h < depth:
        step = min(h, depth - h)
        key = rank * (int(rank.max(initial=0)) + 1)
        key[: n - step] += rank[step:]
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        # 0 stays 0: it marks an end
        rank[order] = np.cumsum(np.concatenate([[ranked[0] > 0], ranked[1:] != ranked[:-1]])) if n else 0
        h += step
    common, same = np.zeros(n, np.int8), np.ones(max(n - 1, 0), bool)
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    for k in range(depth):
        at = padded[order + k]
        same &= at[1:] == at[:-1]
        common[1:] += same
    return order, common


def intervals(ids, depth: int, least: int = 1):
    """For each length from ``least`` to ``depth``: (first positions, counts) of all n-grams without an id 0, from the LCP intervals."""
    import numpy as np

    order, common = suffix_array(ids, depth)
    ends = np.flatnonzero(np.concatenate([ids, [0]]) == 0)
    room = ends[np.searchsorted(ends, order)] - order  # ids before the next 0
    for n in range(least, depth + 1):
        starts = np.flatnonzero(common < n)
        counts = np.diff(np.append(starts, len(ids)))
        whole = room[starts] >= n
        yield n, order[starts[whole]], counts[whole]


def stretches(ids, good, n: int):
    """The ids of all n-grams that ``good`` marks at their first place, those that overlap in one stretch; a 0 ends each."""
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]])))
    starts, lengths = edges[::2], edges[1::2] - edges[::2] + n - 1
    ends = np.cumsum(lengths)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    out = np.zeros(len(within) + len(starts), ids.dtype)
    out[within + np.repeat(ends - lengths + np.arange(len(starts)), lengths)] = ids[within + np.repeat(starts, lengths)]
    return out


def _has(bits, hashes):
    import numpy as np

    at = hashes & np.uint64(len(bits) * 8 - 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


class _Ids(dict):
    """Numbers new words on the way."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Shard:
    """The words of some texts of one language as ids from 1; 0 ends a piece."""

    def __init__(self, lang: str) -> None:
        self.lang, self.known, self.parts = lang, _Ids({END: 0}), []

    def add(self, text: bytes) -> int:
        """Take all words of ``text``; returns their number, ends counted."""
        import numpy as np

        words = text.replace(END, b" " + END + b" ").split()  # at blanks and tabs, the only white space left
        words.append(END)
        self.parts.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        return len(words)

    def close(self) -> None:
        import numpy as np
        from xxhash import xxh64_intdigest

        self.ids, self.parts = np.concatenate(self.parts), []
        lang = self.lang.encode() + b"\x00"
        self.hashes = np.fromiter((xxh64_intdigest(lang + w, SEED) for w in self.known), np.uint64, len(self.known))

    def buckets(self, ids, at, n: int, bits: int):
        """The bucket of the n-gram at each place: ``bits`` bits of a hash."""
        import numpy as np

        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = (key + self.hashes[ids[at + k]]) * np.uint64(MIX)
        return (key >> np.uint64(64 - bits)).view(np.int64)

    def good(self, filters: list):
        """For each length up to that of ``filters`` and one: whether all shorter parts of the n-gram at a place may be frequent.

        ``filters`` has that of the words, then (bits, filter) of pairs and so on.
        """
        import numpy as np

        word = _has(filters[0], self.hashes)
        word[0] = False
        found = [word[self.ids]]
        for n, (bits, held) in enumerate(filters[1:], start=2):
            fits = found[-1][:-1] & found[-1][1:]
            at = np.flatnonzero(fits)
            fits[at] = _has(held, self.buckets(self.ids, at, n, bits).view(np.uint64))
            found.append(fits)
        return [*found, found[-1][:-1] & found[-1][1:]]

    def gram_counts(self, n: int, bits: int, filters: list):
        """(buckets, counts) of the n-grams whose parts may be frequent."""
        ids = stretches(self.ids, self.good(filters)[-1], n)
        _, at, counts = next(intervals(ids, n, n))
        return self.buckets(ids, at, n, bits), counts

    def phrase_counts(self, most: int, filters: list):
        """(phrases, length, counts) as Arrow arrays: all phrases whose parts may be frequent, or all words if nothing is known of them."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        named = pa.array(self.known, pa.binary())
        if not filters:
            words = np.arange(1, len(named), dtype=np.int32)
            found = [(1, words, np.arange(len(words)), np.bincount(self.ids, minlength=len(named))[1:])]
        else:
            found, good = [], self.good(filters)
            for n in range(2, len(filters) + 1):
                ids = stretches(self.ids, good[n - 1], n)
                padded = np.concatenate([ids, np.zeros(most, ids.dtype)])
                found += [(k, padded, at, count) for k, at, count in intervals(ids, n if n < len(filters) else most, n)]
        for n, ids, at, count in found:
            for k in range(0, len(at), BATCH_ROWS):
                part = at[k : k + BATCH_ROWS]
                phrase = pc.binary_join_element_wise(*[named.take(pa.array(ids[part + j])) for j in range(n)], b" ")
                yield phrase.cast(pa.string()), n, pa.array(count[k : k + BATCH_ROWS], pa.int64())


def _scanned(docs: DataFrame, rows_of, schema: str) -> DataFrame:
    """What ``rows_of`` gives for each shard: batches of the columns of ``schema``."""

    def scan(batches):
        shards, size = {}, 0

        def flush():
            for lang in sorted(shards):
                shard = shards.pop(lang)
                shard.close()
                yield from rows_of(shard)

        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, at = text.as_py().encode().translate(_MAP), 0
                while at < len(data):
                    end = data.find(END, at + TEXT_BYTES) + 1 or len(data)
                    if lang not in shards:
                        shards[lang] = Shard(lang)
                    size += shards[lang].add(data[at:end])
                    at = end
                    if size >= SHARD_WORDS:
                        yield from flush()
                        size = 0
        yield from flush()

    slim = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"))
    return slim.mapInArrow(scan, schema)


def _texts(docs: DataFrame, most: int, filters) -> DataFrame:
    """(lang, phrase, words, n): the counts of :meth:`Shard.phrase_counts` over all shards."""

    def rows(shard):
        import pyarrow as pa

        for phrase, n, counts in shard.phrase_counts(most, filters()):
            size = len(phrase)
            yield pa.record_batch([pa.array([shard.lang] * size, pa.string()), phrase, pa.array([n] * size, pa.int32()), counts], names=["lang", "phrase", "words", "n"])

    return _scanned(docs, rows, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def _keys(docs: DataFrame, n: int, bits: int, filters) -> DataFrame:
    """(key, n): the counts of :meth:`Shard.gram_counts` over all shards."""

    def rows(shard):
        import pyarrow as pa

        keys, counts = shard.gram_counts(n, bits, filters())
        yield pa.record_batch([pa.array(keys), pa.array(counts, pa.int64())], names=["key", "n"])

    return _scanned(docs, rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _filter(keys: DataFrame, bits: int):
    """The column ``key``, modulo the size, as a broadcast array of at most ``bits`` bits; bounded by MOST_BITS."""
    import numpy as np

    bits = min(MOST_BITS, bits)
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    rows = keys.select(F.shiftright(at, 6).alias("block"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = rows.groupBy("block").agg(F.bit_or("bit").alias("bits")).toArrow()  # 16 bytes for each 64 bits
    blocks = np.zeros(bits // 64, "<i8")
    blocks[found["block"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(blocks.view(np.uint8))


def phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases found at least ``least`` times, and (lang, total) of all words.

    The parts of a frequent phrase are frequent. So words are counted first,
    then pairs of frequent words and triples of frequent pairs, these by buckets
    of a hash, of which there are ``BUCKETS`` times as many as phrases can be
    frequent. Filters of bounded size tell the tasks of the last pass what may
    be frequent; that pass counts the phrases themselves. What collisions let
    through is rare by its own count and dropped: counts are exact.
    """
    everything = cut(_texts(docs, 1, list))
    totals = cut(everything.groupBy("lang").agg(F.sum("n").alias("total")))
    words = everything.where(F.col("n") >= least)
    known = words.select(F.xxhash64(F.concat("lang", F.lit("\x00"), "phrase")).alias("key"))  # as Shard.close
    filters = [_filter(known, 1 << max(10, (FILTER_BITS * known.count()).bit_length()))]
    opened = lambda: [filters[0].value, *[(bits, held.value) for bits, held in filters[1:]]]  # noqa: E731  in a task
    buckets = max(10, (BUCKETS * (totals.agg(F.sum("total")).first()[0] or 0) // least).bit_length())
    for n in (2, 3)[: most_words - 1]:
        many = cut(_keys(docs, n, buckets, opened).where(F.col("n") >= least))
        filters.append((buckets, _filter(many, 1 << buckets)))
    longer = cut(_texts(docs, most_words, opened).where(F.col("n") >= least))
    return words.unionByName(longer), totals


def _part(first: Column, last: Column) -> Column:
    """Words ``first`` to ``last`` (from 1) of the phrase."""
    return F.array_join(F.slice(F.split("phrase", " "), first, last - first + 1), " ")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by how much more often their parts meet than by chance: lang, rank, phrase, a, l, r, n, score.

    Needs columns lang and text; others are ignored, whatever their names. A
    null text counts as empty, a null lang as ``und``; empty texts and tables
    add nothing, and repeated rows count each time. A phrase counts only within
    a piece between marks or line ends, and occurrences may overlap. Ranks go
    by score, then count, both falling, then by the phrase's bytes; so ties
    have one order. Products are taken as DECIMAL(38, 0).

    A phrase that lies in a longer one as frequent is dropped. Of such a longer
    one, the parts between have the same count, so phrases of one word more
    decide.
    """
    found, totals = phrases(docs, least, most_words)
    longer = found.where("words > 2")
    inside = longer.select("lang", F.explode(F.array(_part(F.lit(1), F.col("words") - 1), _part(F.lit(2), F.col("words")))).alias("phrase"), "n")
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("held"))
    whole = found.where("words > 1").join(inside, ["lang", "phrase"], "left").where("held IS NULL OR held < n").drop("held")

    cuts = whole.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words")).alias("right"))
    parts = found.select("lang", F.col("phrase").alias("part"), "n")
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    big = lambda c: c.cast("decimal(19,0)")
    cuts = cuts.join(F.broadcast(totals), "lang")  # one row for each language
    over = big(F.lit(1000) * F.col("a")) * big(F.col("total"))
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", "total", over.alias("over"), (big(F.col("l")) * big(F.col("r"))).alias("under"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    scored = cut(scored.select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows, before = scored.count(), None
    while rows > RANK_ROWS and (before is None or rows < before // 2):  # the first of each part hold the first of all
        part = F.pmod(F.xxhash64("phrase"), F.lit(1 + rows // RANK_ROWS))
        best = scored.withColumn("part", part).withColumn("at", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
        scored = cut(best.where(F.col("at") <= top).drop("part", "at"))
        rows, before = scored.count(), rows
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    return scored.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score").where(F.col("rank") <= top)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS at
  FROM (SELECT lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\n\x0B\f\r]') AS p FROM documents)
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM worded WHERE len(w) > 0
), grams AS (
  SELECT lang, k AS words, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE s + k - 1 <= len(w)
), counted AS (
  SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), inner_parts AS (
  SELECT DISTINCT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, f
  FROM (SELECT lang, string_split(phrase, ' ') AS w, words, f, unnest(range(1, words + 1)) AS s FROM counted WHERE words > 2),
       (SELECT unnest([2, 3, 4]) AS k) WHERE k < words AND s + k - 1 <= words
), kept AS (
  SELECT * FROM counted c WHERE words > 1 AND NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f)
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:words], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, c.k, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.head JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
