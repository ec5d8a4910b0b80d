"""Entity resolution: similar records, clusters and one golden record each.

1. Records that agree on an identity (the same DOI, or equal in every compared
   field) are one *variant*. They are linked to the lowest record id only, so a
   group of copies costs one link per copy, however large it is.
2. Variants are matched by exact similarity joins, then scored over all compared
   fields: on the words of a gate field, or, without a gate, by a bound of the
   score over all fields, worked out from sketches of the values of any two.
3. Clusters are the connected components of the matches above the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import (
    clean_value,
    first_non_blank,
    is_usable,
    normalize_doi,
    strip,
    tokens,
)
from reviewlake.scale import cut_lineage, id_index, joined_items, lookup, ordered_items

# Sizes of sets that share a level differ by less than this factor.
LEVEL_BASE = 2
# A pair has to share so many members of its prefixes, as a part of the least size of its level,
# and one key for so many of these members.
SHARED_PART, KEYS_PART = 0.25, 5
# Two members make a key where groups have not more members than this.
MEMBERS_PER_GROUP = 16
# Else a pair has to share one more rare word per this many words of its sets.
WORDS_PER_SHARED = 25
# Sets that are turned into keys at a time.
SLICE_ROWS = 64
# Texts that find pairs have to be at least so similar, unless all fields are needed.
LEAST_DRIVER = 0.6
# Cells in which members of sets are counted; their counts are broadcast.
FREQUENCY_CELLS = 1 << 17
# Pairs of one record that are scored in one place.
PAIRS_PLACE = 4_096
# A sketch has so many bits per member of its set at least, but in all not less or more than these.
SKETCH_BITS, LEAST_BITS, MOST_BITS = 4, 1 << 8, 1 << 14
# Members that texts are sketched by have so many characters.
SKETCH_GRAM = 2
# Bits per member that sketches are folded to where all pairs of a tile are compared.
TILE_BITS = 1.8
# Sketches are compared in blocks of about so many records, and inside them in tiles of so many
# records and bits. No more than so many parts of blocks meet each other in tasks of their own.
BLOCK_ROWS, TILE_ROWS, TILE_SIZE, BLOCK_PARTS = 16_384, 512, 1 << 21, 64
# Records of a block meet on the rare words of their main field where these have to be so
# similar at least. Then they share so many of them, or all; so many meetings are held at a time.
LEAST_MEETING, RARE_SHARED, MEETINGS_HELD = 0.3, 4, 1 << 18
# Records that are linked first agree in so many minima of their sets, so many times over.
BAND_MINIMA, BANDS = 6, 8


@dataclass(frozen=True)
class Field:
    """A compared field: how it is compared and how much it weighs."""

    name: str
    comparator: str = "text"  # text | words | equal | doi
    weight: float = 1.0


DEFAULT_FIELDS = (
    Field("title", "text", 0.4),
    Field("authors", "text", 0.2),
    Field("keywords", "words", 0.1),
    Field("source", "text", 0.1),
    Field("doi", "doi", 0.2),
)


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer text."""
    longer = F.greatest(F.length(a), F.length(b))
    return 1 - F.try_divide(F.levenshtein(a, b), longer)


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct words; null when one is empty."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.try_divide(common, both - common))


def _compared(field: Field) -> Column:
    if field.comparator == "doi":
        doi = normalize_doi(field.name)
        return F.when(doi != "n/a", doi)
    cleaned = clean_value(field.name)
    if field.comparator != "words":
        return cleaned
    words = F.sort_array(tokens(cleaned))
    return F.when(F.size(words) > 0, words)


def compared_fields(fields: Sequence[Field] = DEFAULT_FIELDS) -> Column:
    """Struct of the cleaned values that scores are computed from."""
    return F.struct(*[_compared(f).alias(f.name) for f in fields])


def comparable(
    records: DataFrame, fields: Sequence[Field], gate: str, id_col: str = "record_id"
) -> DataFrame:
    """``(id, v, words)``: compared values and gate words, computed once.

    Cleaning and cutting texts costs more than writing the result, and every
    later step reads it. Words are written as one text: an array takes three
    times its room.
    """
    read = dict.fromkeys([*[f.name for f in fields], gate])
    placed = records.select(F.col(id_col).alias("id"), *read).repartition("id")
    table = placed.select("id", compared_fields(fields).alias("v"), gate)
    none = F.array().cast("array<string>")
    if any(f.name == gate and f.comparator == "words" for f in fields):
        # Written once, not under both names.
        kept = cut_lineage(table.select("id", _packed("v", fields).alias("v")))
        kept = kept.select("id", _unpacked("v", fields).alias("v"))
        return kept.withColumn("words", F.coalesce(f"v.{gate}", none))
    words = F.array_join(F.sort_array(tokens(clean_value(gate))), " ")
    kept = cut_lineage(table.select("id", _packed("v", fields).alias("v"), words.alias("words")))
    cut = F.when(F.col("words") != "", F.split("words", " "))
    return kept.select("id", _unpacked("v", fields).alias("v"), F.coalesce(cut, none).alias("words"))


def _packed(v: str, fields: Sequence[Field]) -> Column:
    """A struct of compared values with lists of words as one text; no word holds a space."""
    values = {f.name: F.col(f"{v}.{f.name}") for f in fields}
    return F.struct(
        *[(F.array_join(values[f.name], " ") if f.comparator == "words" else values[f.name]).alias(f.name) for f in fields]
    )


def _unpacked(v: str, fields: Sequence[Field]) -> Column:
    """Undo :func:`_packed`."""
    values = {f.name: F.col(f"{v}.{f.name}") for f in fields}
    return F.struct(
        *[(F.split(values[f.name], " ") if f.comparator == "words" else values[f.name]).alias(f.name) for f in fields]
    )


def _field_score(field: Field, a: Column, b: Column) -> Column:
    if field.comparator == "words":
        return set_similarity(a, b)
    if field.comparator == "text":
        return text_similarity(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("double"))


def _once(c: Column) -> Column:
    """Evaluate a costly value once per row.

    A filter on the output of a generator stays above it; a filter on a plain
    column would be pushed down together with a copy of its expression.
    """
    return F.explode(F.array(c))


def with_score(
    pairs: DataFrame, fields: Sequence[Field], known: dict[str, Column] | None = None
) -> DataFrame:
    """Add ``score`` to pairs with structs ``l`` and ``r``.

    It is the weighted mean over the fields both sides have; 0 without any.
    ``known`` gives field scores that are computed already.
    """
    known = known or {}
    scores = [
        known[f.name] if f.name in known else _field_score(f, F.col(f"l.{f.name}"), F.col(f"r.{f.name}"))
        for f in fields
    ]
    parts = pairs.select("*", _once(F.array(*scores)).alias("_s"))
    total, weight = F.lit(0.0), F.lit(0.0)
    for i, f in enumerate(fields):
        s = F.col("_s")[i]
        total = total + F.coalesce(s * f.weight, F.lit(0.0))
        weight = weight + F.when(s.isNotNull(), F.lit(f.weight)).otherwise(F.lit(0.0))
    return parts.withColumn("score", F.coalesce(F.try_divide(total, weight), F.lit(0.0))).drop("_s")


def identity_links(table: DataFrame, fields: Sequence[Field] = DEFAULT_FIELDS) -> DataFrame:
    """``(src, dst)``: each record to the lowest id it shares an identity with.

    Identities are the digest of all compared values and, where there is a DOI
    field, the normalised DOI. ``table`` comes from :func:`comparable`.
    """
    values = [
        F.coalesce(F.concat(F.lit("="), F.col(f"v.{f.name}").cast("string")), F.lit("-"))
        for f in fields
    ]
    # Without any value there is no evidence that two records are the same.
    filled = F.coalesce(*[F.when(F.col(f"v.{f.name}").isNotNull(), F.lit(1)) for f in fields])
    keys = [F.when(filled == 1, F.sha2(F.concat_ws("\u0001", *values), 256))]
    keys += [F.concat(F.lit("doi:"), f"v.{f.name}") for f in fields if f.comparator == "doi"]
    keyed = table.select(
        F.col("id").alias("src"), F.explode(F.array_compact(F.array(*keys))).alias("key")
    )
    shared = keyed.groupBy("key").agg(F.min("src").alias("dst"), F.count("*").alias("n"))
    shared = shared.where(F.col("n") > 1)
    found = lookup(keyed, shared, ["key"], "n", "src", how="inner")
    links = found.where(F.col("src") != F.col("dst")).select("src", "dst")
    return links.distinct() if len(keys) > 1 else links


def identity_groups(table: DataFrame, fields: Sequence[Field] = DEFAULT_FIELDS) -> DataFrame:
    """``(id, component)`` of the records that are the same by identity."""
    links = cut_lineage(identity_links(table, fields))
    if any(f.comparator == "doi" for f in fields):
        return connected_components(links)
    # With one kind of identity every link goes to the lowest id already.
    return links.select(F.col("src").alias("id"), F.col("dst").alias("component"))


def _copies(same: DataFrame) -> DataFrame:
    return same.where(F.col("id") != F.col("component")).select("id")


def variants(table: DataFrame, same: DataFrame) -> DataFrame:
    """Rows without the copies that ``same (id, component)`` puts under a lower id."""
    return table.join(_copies(same), "id", "left_anti")


def _shared_least(n: np.ndarray | int, theta: float, q: int) -> np.ndarray:
    """How many members a set of size n shares at least with any set it is ``theta`` similar to.

    With ``q`` 0 the similarity is the Jaccard index. Else the sets hold the
    padded q-grams of texts, of which an edit touches q, and the similarity is
    one less the edits per character of the longer text.
    """
    least = n * theta if q == 0 else (n - q + 1) * (1 - q * (1 - theta)) + q - 1
    return np.maximum(np.ceil(least - 1e-9), 1).astype(np.int64)


def _level_rule(level: int, theta: float, q: int) -> tuple[int, int, int]:
    """``(groups, shared, need)`` of the pairs whose larger set is of a level.

    Such a pair shares at least ``shared`` members of the prefixes, and at least
    ``need`` keys. With groups a key is two members of one group: where ``s``
    members are shared, at least ``s - groups`` such keys are. Without, a key is
    one member.
    """
    low = LEVEL_BASE**level
    least = int(_shared_least(low, theta, q))
    shared = min(least, max(2, int(low * SHARED_PART)))
    need = max(1, shared // KEYS_PART)
    if shared > need and (shared - need) * MEMBERS_PER_GROUP >= low:
        return shared - need, shared, need
    shared = min(least, low // WORDS_PER_SHARED + 1)
    return 0, shared, shared


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def _set_keys(
    words: np.ndarray, row: np.ndarray, n: np.ndarray, frequency: np.ndarray, theta: float, q: int
) -> Iterator[tuple[np.ndarray, ...]]:
    """``(row, key, need, own)`` of the sets of one space, level by level.

    ``words`` are hashes of the members, ``row`` their sets, ascending. Members
    are put in one order, about from rare to frequent; any order is exact. Two
    sets that share at least ``o`` members share ``m`` of them among the first
    ``n - o + m`` of each, for every m up to o.
    """
    order = np.lexsort((words, frequency[words % np.uint64(FREQUENCY_CELLS)], row))
    words, starts = words[order], np.cumsum(n) - n
    place = np.arange(len(words))
    # Equal members of a multiset are told apart by their turn.
    new = np.r_[True, (words[1:] != words[:-1]) | (row[1:] != row[:-1])]
    turn = place - np.maximum.accumulate(np.where(new, place, 0))
    members = _mixed(words + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least, most = _shared_least(n, theta, q), _most(n, theta, q)
    bounds = np.array([LEVEL_BASE**i for i in range(32)])
    first, last = (np.searchsorted(bounds, size, "right") - 1 for size in (n, most))
    for level in range(first.min(), last.max() + 1):
        groups, shared, need = _level_rule(level, theta, q)
        prefix = np.where((first <= level) & (level <= last), n - least + shared, 0)
        kept = place - starts[row] < prefix[row]
        own, of = members[kept], row[kept]
        salt = np.uint64(2 * level + 1)
        if groups:
            group = (own >> np.uint64(20)) % np.uint64(groups)
            # The order of the members stays inside a group.
            by = np.lexsort((group, of))
            own, of, group = own[by], of[by], group[by]
            keys, rows, gap = [], [], 1
            while gap < len(own):
                same = (of[gap:] == of[:-gap]) & (group[gap:] == group[:-gap])
                if not same.any():
                    break
                keys.append(_mixed(own[:-gap][same] * np.uint64(0xD6E8FEB86659FD93) + own[gap:][same] + salt))
                rows.append(of[gap:][same])
                gap += 1
            own, of = np.concatenate([own[:0], *keys]), np.concatenate([of[:0], *rows])
        else:
            own = _mixed(own + salt)
        yield of, own, np.full(len(of), need), first[of] == level


def _most(n: np.ndarray, theta: float, q: int) -> np.ndarray:
    """The size of the largest set that one of size n may be similar to."""
    # Both kinds of similarity are at most the smaller size over the larger one.
    pad = max(q - 1, 0)
    return np.minimum(np.floor((n - pad) / theta + pad + 1e-6), 1 << 30).astype(np.int64)


def _placed_keys(sets: DataFrame, spaces: Sequence[tuple[float, int]]) -> DataFrame:
    """``(id, word, n, most, need, own)`` rows of an inverted index of sets.

    ``sets (id, space, words)`` are records and hashes of the members of their
    sets; a space has its theta and q in ``spaces``. Two sets that are similar
    enough share at least ``need`` values of ``word``, of rows of which one is
    its set's ``own``, that is of the level of the larger set. Most words are two
    members of a set, so few sets meet by chance, however many there are.
    """
    sets = sets.where(F.col("id").isNotNull() & (F.size("words") > 0))
    # Rows with one id are one set.
    sets = sets.groupBy("id", "space").agg(F.flatten(F.collect_list("words")).alias("words"))
    cells = F.transform("words", lambda w: F.pmod(w, F.lit(FREQUENCY_CELLS)).cast("int"))
    counted = sets.select(F.explode(cells).alias("cell")).groupBy("cell").agg(F.count("*").alias("f")).collect()
    # Words that share a cell share their count, so this has a fixed number of rows.
    known = np.zeros(FREQUENCY_CELLS, np.int64)
    known[[r["cell"] for r in counted]] = [r["f"] for r in counted]
    shared = sets.sparkSession.sparkContext.broadcast(known)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            space = batch.column("space").to_numpy(zero_copy_only=False)
            for k in np.unique(space):
                part = batch.filter(pa.array(space == k))
                lists, (theta, q) = part.column("words"), spaces[k]
                n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                row, most = np.repeat(np.arange(len(n)), n), _most(n, theta, q)
                for of, word, need, own in _set_keys(words, row, n, shared.value, theta, q):
                    if len(of):
                        word = _mixed(word + np.uint64(int(k) * 64 + 1)).view(np.int64)
                        columns = [word, n[of].astype(np.int32), most[of].astype(np.int32), need.astype(np.int32), own]
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id").take(pa.array(of)), *[pa.array(c) for c in columns]],
                            ["id", "word", "n", "most", "need", "own"],
                        )

    id_type = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "space", "words").mapInArrow(
        keys, f"id {id_type}, word long, n int, most int, need int, own boolean"
    )


def _rare_words(table: DataFrame, least: float) -> DataFrame:
    """The index of the gate words of records that may reach Jaccard ``least``."""
    words = F.transform("words", lambda w: F.xxhash64(w)).alias("words")
    return _placed_keys(table.select("id", F.lit(0).alias("space"), words), [(float(least), 0)])


def _may_match() -> Column:
    """Size and level filter for rows ``a`` and ``b`` that share a word."""
    sizes = (F.col("a.n") <= F.col("b.most")) & (F.col("b.n") <= F.col("a.most"))
    return sizes & (F.col("a.own") | F.col("b.own"))


def _enough(met: DataFrame) -> DataFrame:
    """``(left_id, right_id)`` of meetings ``a``, ``b`` that share enough words."""
    return (
        met.groupBy(F.least("a.id", "b.id").alias("left_id"), F.greatest("a.id", "b.id").alias("right_id"))
        .agg(F.count("*").alias("met"), F.min(F.least("a.need", "b.need")).alias("need"))
        .where(F.col("met") >= F.col("need"))
        .select("left_id", "right_id")
    )


def _meetings(a: DataFrame, b: DataFrame, rule: Column) -> DataFrame:
    """Pairs that meet on enough of their words."""
    same = F.col("a.word") == F.col("b.word")
    return _enough(a.alias("a").join(b.alias("b"), same).where(rule & _may_match()))


def drivers(masks: Sequence[int], fields: Sequence[Field], threshold: float, cost: Sequence[float]):
    """``(lower mask, higher mask, field, theta, q)``: what finds the pairs of two kinds of records.

    A mask says which fields a record has. Of the fields P that both have, some
    set D is chosen: were all of them less similar than
    ``theta = (t W(P) - W(P - D)) / W(D)``, the score could not reach t even if
    the others agreed. So each pair that reaches it is found by a field of D.
    The cheapest D is taken, by ``cost``, the meetings a field's values make.
    """
    out = []
    for i, low in enumerate(masks):
        for high in masks[i:]:
            both = [k for k in range(len(fields)) if low >> k & high >> k & 1]
            whole = sum(fields[k].weight for k in both)
            best = None
            for chosen in range(1, 1 << len(both)):
                some = [k for j, k in enumerate(both) if chosen >> j & 1]
                own = sum(fields[k].weight for k in some)
                if own <= 0:
                    continue
                theta = (threshold * whole - (whole - own)) / own
                texts = any(fields[k].comparator == "text" for k in some)
                if theta < (LEAST_DRIVER if texts else 1e-3) and len(some) < len(both):
                    continue
                # Equal values meet at any theta; short prefixes make other fields cheaper.
                price = sum(
                    cost[k] * (1 if fields[k].comparator in ("equal", "doi") else max(theta, 1e-3) ** -4) for k in some
                )
                if best is None or price < best[0]:
                    best = (price, some, theta - 1e-9)
            if best:
                for k in best[1]:
                    q = 0 if fields[k].comparator != "text" else 3 if best[2] >= 0.75 else 2 if best[2] >= 0.5 else 1
                    out.append((low, high, k, best[2], q))
    return out


def _grams(text: Column, q: Column) -> Column:
    """The q-grams of a text with q - 1 marks before and after it."""
    pad = F.repeat(F.lit("\u0001"), q - 1)
    padded = F.concat(pad, text, pad)
    return F.transform(F.sequence(F.lit(1), F.length(text) + q - 1), lambda i: F.substring(padded, i, q))


def field_index(table: DataFrame, fields: Sequence[Field], threshold: float) -> DataFrame | None:
    """The index of all fields by which pairs that reach ``threshold`` are found; None without any.

    Values of words are sets of words, texts are multisets of q-grams, others
    are one word each.
    """
    mask = F.lit(0)
    for k, f in enumerate(fields):
        mask = mask + F.when(F.col(f"v.{f.name}").isNotNull(), F.lit(1 << k)).otherwise(F.lit(0))
    masked = table.select("id", "v", mask.alias("mask"))
    # As many rows as kinds of records; at most two to the number of fields.
    masks = sorted(r["mask"] for r in masked.select("mask").distinct().collect() if r["mask"])
    kept = [F.struct(F.lit(k).alias("k"), F.xxhash64(f"v.{f.name}").alias("value")) for k, f in enumerate(fields)]
    counted = table.select(F.inline(F.array(*kept))).groupBy("k", "value").agg(F.count("*").cast("double").alias("n"))
    squares = {r["k"]: r["s"] for r in counted.groupBy("k").agg(F.sum(F.col("n") * F.col("n")).alias("s")).collect()}
    plan = drivers(masks, fields, threshold, [squares.get(k, 1.0) for k in range(len(fields))])
    if not plan:
        return None
    # A record of mask m takes part in a space for each partner's mask.
    rows = {(m, space, k, t, q) for space, (low, high, k, t, q) in enumerate(plan) for m in (low, high)}
    spaces = table.sparkSession.createDataFrame(sorted(rows), "mask int, space int, k int, theta double, q int")
    placed = masked.join(F.broadcast(spaces), "mask").select("id", "v", "mask", "space", "k", "theta", "q")
    words = None
    for k, f in enumerate(fields):
        value = F.col(f"v.{f.name}")
        own = value if f.comparator == "words" else F.array(value)
        own = _grams(value, F.col("q")) if f.comparator == "text" else own
        words = F.when(F.col("k") == k, own) if words is None else words.when(F.col("k") == k, own)
    # A collision of hashes only adds a meeting.
    sets = placed.select("id", "space", F.transform(words, lambda w: F.xxhash64(w)).alias("words"))
    return _placed_keys(sets, [(theta, q) for _, _, _, theta, q in plan])

def _is_set(field: Field) -> bool:
    return field.comparator in ("words", "text")


def _set_fields(fields: Sequence[Field]) -> list[int]:
    """The numbers of the fields with sets, those that weigh most first."""
    return sorted((k for k, f in enumerate(fields) if _is_set(f)), key=lambda k: -fields[k].weight)


def _sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set of size n: a power of two."""
    bits = 2 ** np.ceil(np.log2(np.maximum(SKETCH_BITS * n, LEAST_BITS))).astype(np.int64)
    return np.minimum(bits, MOST_BITS)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches with 64 bits a word, folded to fewer words; what differs less than before stays so."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _sketches(lists: pa.Array) -> tuple[np.ndarray, list[bytes | None]]:
    """Sizes and sketches of sets of hashes; None for a null.

    A bit of a sketch says whether an odd number of members fall on it. So two
    sketches differ in no more bits than the sets differ in members.
    """
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    members = _mixed(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    bits, out = _sketch_bits(n), [None] * len(n)
    row = np.repeat(np.arange(len(n)), n)
    for size in np.unique(bits[n > 0]):
        rows = np.flatnonzero((bits == size) & (n > 0))
        at = np.full(len(n), -1)
        at[rows] = np.arange(len(rows))
        kept = at[row] >= 0
        places = at[row[kept]] * size + (members[kept] & np.uint64(size - 1)).astype(np.int64)
        odd = (np.bincount(places, minlength=len(rows) * size) & 1).astype(np.uint8).reshape(len(rows), size)
        for i, packed in zip(rows, np.packbits(odd, axis=1), strict=True):
            out[i] = packed.tobytes()
    return n, out


def _bands(lists: pa.Array, n: np.ndarray) -> pa.Array:
    """Keys that similar sets are likely to share: minima of their members, several to a key."""
    members = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    members, row = _mixed(members + np.uint64(77)), np.repeat(np.arange(len(n)), n)
    minima = np.full((len(n), BANDS * BAND_MINIMA), np.uint64(2**64 - 1))
    which = (members % np.uint64(BANDS * BAND_MINIMA)).astype(np.int64)
    np.minimum.at(minima, (row, which), members)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(n), 1))
    for i in range(BAND_MINIMA):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + minima[:, i::BAND_MINIMA])
    filled = n > 0
    starts = np.r_[0, np.cumsum(np.where(filled, BANDS, 0))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(keys[filled].ravel().view(np.int64)))


def _frequencies(words: DataFrame) -> np.ndarray:
    """How many of the hashes in ``words (words)`` fall in each cell."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FREQUENCY_CELLS, np.int64)
        for batch in batches:
            members = batch.column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            total += np.bincount((members % np.uint64(FREQUENCY_CELLS)).astype(np.int64), minlength=FREQUENCY_CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "f"])

    counted = words.mapInArrow(counts, "cell long, f long").groupBy("cell").agg(F.sum("f").alias("f")).toArrow()
    # Words that share a cell share their count, so this has a fixed number of rows.
    known = np.zeros(FREQUENCY_CELLS, np.int64)
    known[counted["cell"].to_numpy()] = counted["f"].to_numpy()
    return known


def _least_main(fields: Sequence[Field], threshold: float) -> float | None:
    """How similar the words of the main field are at least where all others agree; None if they need not meet."""
    sets = _set_fields(fields)
    if not sets or fields[sets[0]].comparator != "words":
        return None
    whole, own = sum(f.weight for f in fields), fields[sets[0]].weight
    theta = (threshold * whole - (whole - own)) / own
    return theta - 1e-6 if theta >= LEAST_MEETING else None


def _rare_prefix(n: np.ndarray, theta: float) -> np.ndarray:
    """So many of the rarest words of a set share some with those of any set it is ``theta`` similar to."""
    least = _shared_least(n, theta, 0)
    return n - least + np.minimum(least, RARE_SHARED)


def _rare_first(lists: pa.Array, n: np.ndarray, theta: float, frequency: np.ndarray) -> pa.Array:
    """The rarest hashes of sets in one order for all of them, 32 bits of each, as bytes."""
    members = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    row, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    order = np.lexsort((members, frequency[(members % np.uint64(FREQUENCY_CELLS)).astype(np.int64)], row))
    kept = np.arange(len(members)) - starts[row] < _rare_prefix(n, theta)[row]
    rare = (_mixed(members[order][kept]) >> np.uint64(32)).astype(np.uint32)
    ends = np.r_[0, np.cumsum(np.where(n > 0, _rare_prefix(np.maximum(n, 1), theta), 0))].astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(rare)])


def sketched(
    table: DataFrame, fields: Sequence[Field], threshold: float, without: DataFrame | None = None
) -> DataFrame:
    """``(id, mask, several, n0, c0, …, rare, bands)``: a small row for each record, by which pairs are ruled out.

    ``mask`` says which fields it has; of field k there is the size ``nk`` of the
    set of its words or q-grams and its sketch ``sk``, or the hash ``ck`` of its
    value. ``rare`` holds the rarest words of the main field, as many as may be
    needed to meet. Rows of one id and mask are one set; then ``several`` is true.
    ``without (id)`` are records to leave out.
    """
    mask, columns, out = F.lit(0), [], []
    for k, f in enumerate(fields):
        value = F.col(f"v.{f.name}")
        mask = mask + F.when(value.isNotNull(), F.lit(1 << k)).otherwise(F.lit(0))
        if _is_set(f):
            words = value if f.comparator == "words" else _grams(value, F.lit(SKETCH_GRAM))
            columns.append(F.transform(words, lambda w: F.xxhash64(w)).alias(f"m{k}"))
            out += [f"n{k} long", f"s{k} binary"]
        else:
            columns.append(F.xxhash64(value).alias(f"c{k}"))
            out.append(f"c{k} long")
    id_type = table.schema["id"].dataType.simpleString()
    sets = _set_fields(fields)
    names = ["id", "mask", *[c.split()[0] for c in out], "rare", "bands"]
    known = table.where(F.col("id").isNotNull()).select("id", mask.alias("mask"), *columns).where(F.col("mask") > 0)
    theta = _least_main(fields, threshold)
    frequency = None
    if theta is not None:
        counted = _frequencies(known.select(F.col(f"m{sets[0]}").alias("words")))
        frequency = table.sparkSession.sparkContext.broadcast(counted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1_024) for b in batches for at in range(0, b.num_rows, 1_024)):
            made = {"id": batch.column("id"), "mask": batch.column("mask")}
            made["bands"], made["rare"] = pa.nulls(batch.num_rows, pa.list_(pa.int64())), pa.nulls(batch.num_rows, pa.binary())
            for k in range(len(fields)):
                if k not in sets:
                    made[f"c{k}"] = batch.column(f"c{k}")
                    continue
                n, sketches = _sketches(batch.column(f"m{k}"))
                made[f"n{k}"], made[f"s{k}"] = pa.array(n), pa.array(sketches, pa.binary())
                if k == sets[0]:
                    made["bands"] = _bands(batch.column(f"m{k}"), n)
                    if theta is not None:
                        made["rare"] = _rare_first(batch.column(f"m{k}"), n, theta, frequency.value)
            yield pa.RecordBatch.from_arrays([made[c] for c in names], names)

    small = known.mapInArrow(rows, ", ".join([f"id {id_type}", "mask int", *out, "rare binary, bands array<long>"]))
    if without is not None:
        small = small.join(without.select("id"), "id", "left_anti")
    gathered = [
        F.sum(c).alias(c) if c[0] == "n" else F.collect_list(c).alias(c) if c[0] == "s" else F.min(c).alias(c)
        for c in names[2:-2]
    ]
    # Rows that are one set do not meet on single words or minima.
    gathered.append(F.when(F.count("*") == 1, F.min("rare")).alias("rare"))
    bands = F.when(F.count("*") == 1, F.flatten(F.collect_list("bands"))).alias("bands")
    return small.groupBy("id", "mask").agg((F.count("*") > 1).alias("several"), *gathered, bands)


def _one_sketch(sketches: list[bytes]) -> bytes:
    """The sketch of the members of all sets together, as short as the shortest."""
    some = [np.frombuffer(x, np.uint64)[None, :] for x in sketches]
    least = min(x.shape[1] for x in some)
    return np.bitwise_xor.reduce(np.concatenate([_folded(x, least) for x in some])).tobytes()


def _blocks(small: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """``(block, data)``: rows of :func:`sketched` in blocks, those of one mask together, by size."""
    sets = _set_fields(fields)
    order = ["mask", "several", *[f"n{k}" for k in sets]]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(some)
            rows = rows.sort_by([(c, "ascending") for c in order])
            for k in sets:
                one = [x and (x[0].as_buffer().to_pybytes() if len(x) == 1 else _one_sketch(x.as_py())) for x in rows[f"s{k}"]]
                rows = rows.set_column(rows.column_names.index(f"s{k}"), f"s{k}", pa.array([x or None for x in one], pa.binary()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_table(rows)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

        some, held = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 2 * BLOCK_ROWS - held)
                some, held, at = [*some, part], held + part.num_rows, at + part.num_rows
                if held == 2 * BLOCK_ROWS:
                    yield block(some)
                    some, held = [], 0
        if held:
            yield block(some)

    rows = cut_lineage(small)
    parts = min(BLOCK_PARTS, -(-rows.count() // BLOCK_ROWS))
    made = rows.coalesce(max(parts, 1)).mapInArrow(packed, "data binary")
    return cut_lineage(made.select(F.monotonically_increasing_id().alias("block"), "data"))


class _Tile:
    """Some records of a block with one mask, by size; arrays of their sketches."""

    def __init__(self, rows: pa.Table, fields: Sequence[Field], at: int):
        self.at, self.rows, self.mask = at, rows.num_rows, rows["mask"][0].as_py()
        several = rows["several"].to_numpy()
        self.several = several if several.any() else None
        self.group = rows["component"].to_numpy(zero_copy_only=False) if "component" in rows.column_names else None
        self.n, self.code, self.width, self.place, self.whole, self.made = {}, {}, {}, {}, {}, {}
        for k, f in enumerate(fields):
            if not self.mask >> k & 1:
                continue
            if not _is_set(f):
                self.code[k] = rows[f"c{k}"].to_numpy()
                continue
            self.n[k] = rows[f"n{k}"].to_numpy().astype(np.float64)
            sketches = [x.as_buffer() for x in rows[f"s{k}"]]
            self.width[k] = np.array([len(x) // 8 for x in sketches])
            self.place[k], self.whole[k] = np.zeros(self.rows, np.int64), {}
            for w in np.unique(self.width[k]):
                of = np.flatnonzero(self.width[k] == w)
                self.place[k][of] = np.arange(len(of))
                joined = b"".join(sketches[i] for i in of)
                self.whole[k][int(w)] = np.frombuffer(joined, np.uint64).reshape(len(of), w)
        self.words = None
        if self.several is None and not rows["rare"].null_count:
            rare = [x.as_buffer() for x in rows["rare"]]
            self.words = np.frombuffer(b"".join(rare), np.uint32)
            size = np.array([len(x) // 4 for x in rare])
            self.row = np.repeat(np.arange(self.rows, dtype=np.int32), size)
            starts = (np.cumsum(size) - size).astype(np.int32)
            self.rank = np.arange(len(self.row), dtype=np.int32) - np.repeat(starts, size)

    def postings(self, k: int, theta: float, equal: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """The rare words needed to be ``theta`` similar in field k, in order, and their records.

        Records that differ in a value of ``equal`` have other words.
        """
        kind = (theta, *equal)
        if kind not in self.made:
            kept = self.rank < _rare_prefix(self.n[k].astype(np.int64), theta).astype(np.int32)[self.row]
            words, row = self.words[kept].astype(np.uint64), self.row[kept]
            for e in equal:
                words = _mixed(words + _mixed(self.code[e].astype(np.int64).view(np.uint64))[row])
            # Some words more meet by chance.
            found = np.sort((words << np.uint64(32)) | row.astype(np.uint64))
            self.made[kind] = (found >> np.uint64(32)).astype(np.uint32), (found & np.uint64(0xFFFFFFFF)).astype(np.int32)
        return self.made[kind]

    def part(self, start: int, end: int) -> _Tile:
        """Some of the records, to be compared without their rare words."""
        out, s = object.__new__(_Tile), slice(start, end)
        out.at, out.rows, out.mask = self.at + start, end - start, self.mask
        out.several = None if self.several is None else self.several[s]
        out.n, out.code, out.width, out.place = (
            {k: v[s] for k, v in d.items()} for d in (self.n, self.code, self.width, self.place)
        )
        out.whole, out.made, out.words = self.whole, {}, None
        return out

    def parts(self, fields: Sequence[Field]) -> list[_Tile]:
        """Tiles of a size in which all pairs can be compared."""
        if "parts" not in self.made:
            widest = np.maximum.reduce([*self.width.values(), np.full(self.rows, 1)]) * 64
            # Sketches of a tile are as short as its shortest.
            main = next((self.width[k] for k in _set_fields(fields) if k in self.width), widest)
            at, out = 0, []
            while at < self.rows:
                end = min(at + TILE_ROWS, at + int(np.argmax(np.r_[main[at:] != main[at], True])))
                held = np.maximum.accumulate(widest[at:end]) * np.arange(1, end - at + 1)
                end = min(end, at + max(1, int(np.searchsorted(held, TILE_SIZE, "right"))))
                out.append(self.part(at, end))
                at = end
            self.made["parts"] = out
        return self.made["parts"]

    def sketches(self, k: int, of: np.ndarray, words: int) -> np.ndarray:
        """Sketches of records with one width, folded."""
        return _folded(self.whole[k][int(self.width[k][of[0]])][self.place[k][of]], words)

    def plus_minus(self, k: int, words: int) -> np.ndarray:
        """The sketches with 1 and -1 for their bits, as numbers whose products count equal bits."""
        if (k, words) not in self.made:
            folded = np.empty((self.rows, words), np.uint64)
            for w in np.unique(self.width[k]):
                of = np.flatnonzero(self.width[k] == w)
                folded[of] = self.sketches(k, of, words)
            bits = np.unpackbits(folded.view(np.uint8), axis=1)
            self.made[k, words] = 1 - 2 * bits.astype(np.float32)
        return self.made[k, words]

    def least_width(self, k: int) -> int:
        return int(self.width[k].min())


def _tiles(data: bytes, fields: Sequence[Field]) -> tuple[pa.Table, list[_Tile]]:
    rows = pa.ipc.open_stream(data).read_all().combine_chunks()
    kind = 2 * rows["mask"].to_numpy().astype(np.int64) + rows["several"].to_numpy()
    starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    ends = np.r_[starts[1:], len(kind)]
    return rows, [_Tile(rows.slice(i, j - i), fields, int(i)) for i, j in zip(starts, ends, strict=True)]


def _most_similar(field: Field, a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """The highest similarity of sets of sizes a and b whose sketches differ in so many bits."""
    if field.comparator == "words":
        both = a + b
        return np.minimum((both - differ) / (both + differ), np.minimum(a, b) / np.maximum(a, b))
    # An edit touches q q-grams of either text.
    pad = SKETCH_GRAM - 1
    edits = np.maximum(np.ceil(differ / (2 * SKETCH_GRAM) - 1e-6), np.abs(a - b))
    return np.maximum(1 - edits / np.maximum(np.maximum(a, b) - pad, 1), 0)


def _met(
    x: _Tile, y: _Tile, k: int, theta: float, equal: Sequence[int]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Records that share enough rare words to be ``theta`` similar in field k, and the values of ``equal``."""
    (a, i), (b, j) = x.postings(k, theta, equal), y.postings(k, theta, equal)
    low, high = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    hit = np.flatnonzero(high > low)
    hit = hit[np.argsort(i[hit], kind="stable")]
    i, low, many = i[hit], low[hit], (high - low)[hit]
    del a, b, high, hit
    n, m = x.n[k].astype(np.float32), y.n[k].astype(np.float32)
    fewest, largest = np.float32(theta - 1e-5) * n, n / np.float32(theta - 1e-5)
    shared = [np.minimum(_shared_least(t.n[k], theta, 0), RARE_SHARED) for t in (x, y)]
    sizes = m[j]
    ends, at = np.cumsum(many), 0
    while at < len(i):
        # All meetings of a record are held together.
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS_HELD)), at + 1)
        end = int(np.searchsorted(i, i[end - 1], "right"))
        some, of = many[at:end], i[at:end]
        place = np.arange(some.sum()) + np.repeat(low[at:end] - (np.cumsum(some) - some), some)
        size = sizes[place]
        fits = np.flatnonzero((size >= np.repeat(fewest[of], some)) & (size <= np.repeat(largest[of], some)))
        left = np.repeat(of.astype(np.int64) * y.rows, some)[fits]
        pairs = np.sort(left + j[place[fits]])
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)])
        met = np.diff(np.r_[first, len(pairs)])
        left, right = np.divmod(pairs[first], y.rows)
        enough = met >= np.minimum(shared[0][left], shared[1][right])
        yield left[enough], right[enough]
        at = end


def _near(x: _Tile, y: _Tile, fields: Sequence[Field], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places, in their blocks, of the records of two tiles whose score may reach ``threshold``."""
    both = [k for k in range(len(fields)) if x.mask & y.mask & 1 << k]
    whole = sum(fields[k].weight for k in both)
    need, main = threshold * whole - 1e-5, (_set_fields(fields) or [None])[0]
    others = [k for k in both if not _is_set(fields[k])]
    theta = None
    if main in both and x.words is not None and y.words is not None:
        theta = (need - (whole - fields[main].weight)) / fields[main].weight
    if theta is None or theta < LEAST_MEETING - 1e-4:
        for p in x.parts(fields):
            for q in y.parts(fields):
                i, j = _compared_tiles(p, q, fields, threshold)
                yield p.at + i, q.at + j
        return
    # The main field has to be more similar where another one differs.
    more = theta + min((fields[k].weight for k in others), default=2) / fields[main].weight
    found = (pairs for t, equal in ((theta, others), (more, [])) if t <= 1 for pairs in _met(x, y, main, t, equal))
    for i, j in found:
        rest, total = whole, np.zeros(len(i))
        for k in [*others, main, *[k for k in both if k != main and k not in others]]:
            rest -= fields[k].weight
            total = total + fields[k].weight * _most_of(x, y, k, fields[k], i, j)
            kept = total + rest >= need
            i, j, total = i[kept], j[kept], total[kept]
        yield x.at + i, y.at + j


def _compared_tiles(
    x: _Tile, y: _Tile, fields: Sequence[Field], threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the records of two tiles whose score may reach ``threshold``; all pairs are compared.

    Field by field the similarity is replaced by the highest that the sketches
    leave possible, and that of fields not seen yet by 1.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = [k for k in range(len(fields)) if x.mask & y.mask & 1 << k]
    whole = sum(fields[k].weight for k in both)
    need, rest = threshold * whole - 1e-5, whole
    if not both or rest < need:
        return none
    # What cannot be made up for by others comes first, then what weighs most.
    both.sort(key=lambda k: (_is_set(fields[k]) or fields[k].weight <= whole - need, -fields[k].weight))
    for k in both:
        if k in x.n:
            low, high = (x, y) if x.n[k].max() <= y.n[k].max() else (y, x)
            far = _most_similar(fields[k], np.minimum(low.n[k].max(), high.n[k].min()), high.n[k].min(), np.float64(0))
            rest -= fields[k].weight * (1 - float(far))
    if rest < need:
        return none
    i = j = total = None
    rest = whole
    area = x.rows * y.rows
    for k in both:
        f, w = fields[k], fields[k].weight
        rest = rest - w if k != both[-1] else 0
        if i is not None:
            total = total + w * _most_of(x, y, k, f, i, j)
        elif k not in x.n:
            same = x.code[k][:, None] == y.code[k][None, :]
            for tile, turned in ((x, np.s_[:, None]), (y, np.s_[None, :])):
                if tile.several is not None:
                    same = same | tile.several[turned]
            total = same * np.float32(w) + (0 if total is None else total)
        else:
            size = (x.n[k].mean() + y.n[k].mean()) / 2
            least = 1 << max(0, int(np.ceil(np.log2(max(TILE_BITS * size, 64)))) - 6)
            words = min(x.least_width(k), y.least_width(k), least)
            equal = x.plus_minus(k, words) @ y.plus_minus(k, words).T
            theta = (need - rest - (0 if total is None else total.max())) / w
            if theta > 0:
                # Products below this are of sketches that differ too much, whatever else is equal.
                if f.comparator == "words":
                    part = 2 * (1 - theta) / (1 + theta)
                    level = (64 * words - 1) - (part * x.n[k][:, None] + part * y.n[k][None, :])
                    kept = equal >= level.astype(np.float32)
                else:
                    longest = max(x.n[k].max(), y.n[k].max()) - SKETCH_GRAM + 1
                    kept = equal >= 64 * words - 4 * SKETCH_GRAM * (1 - theta) * longest - 1
                many = np.count_nonzero(kept)
                if not many:
                    return none
                if many * 8 < area:
                    i, j = np.nonzero(kept)
                    total = w * _most_of(x, y, k, f, i, j) + (0 if total is None else total[i, j])
            if i is None:
                differ = (64 * words - equal) / 2
                part = _most_similar(f, x.n[k].astype(np.float32)[:, None], y.n[k].astype(np.float32)[None, :], differ)
                total = np.float32(w) * part + (0 if total is None else total)
        kept = total + rest >= need
        if i is not None:
            i, j, total = i[kept], j[kept], total[kept]
        elif np.count_nonzero(kept) * 8 < area or not rest:
            # What was compared by folded sketches is compared by whole ones.
            i, j = np.nonzero(kept)
            done = both[: both.index(k) + 1]
            total = sum(fields[d].weight * _most_of(x, y, d, fields[d], i, j) for d in done)
            kept = total + rest >= need
            i, j, total = i[kept], j[kept], total[kept]
        if i is not None and not len(i):
            return none
    return i, j


def _most_of(x: _Tile, y: _Tile, k: int, field: Field, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The highest similarity of field k of chosen records."""
    if k not in x.n:
        same = x.code[k][i] == y.code[k][j]
        if x.several is not None:
            same = same | x.several[i]
        if y.several is not None:
            same = same | y.several[j]
        return same.astype(np.float64)
    differ = np.zeros(len(i))
    kinds = x.width[k][i] * (MOST_BITS + 1) + y.width[k][j]
    for kind in np.unique(kinds):
        of = np.flatnonzero(kinds == kind)
        words = int(min(divmod(kind, MOST_BITS + 1)))
        for at in range(0, len(of), max(1, TILE_SIZE // words)):
            some = of[at : at + max(1, TILE_SIZE // words)]
            odd = x.sketches(k, i[some], words) ^ y.sketches(k, j[some], words)
            differ[some] = np.bitwise_count(odd).sum(axis=1, dtype=np.int64)
    return _most_similar(field, x.n[k][i], y.n[k][j], differ)


def near_pairs(small: DataFrame, fields: Sequence[Field], threshold: float) -> DataFrame:
    """``(left_id, right_id)`` of all pairs whose score may reach ``threshold``.

    ``small`` comes from :func:`sketched`, and may have a ``component`` of each
    record; pairs of one component are left out. Any two records are compared,
    by some hundred bits, where their blocks meet: no keys are written for them,
    so it takes little disk, and its time grows with the square, from a small start.
    """
    id_type = small.schema["id"].dataType.simpleString()
    blocks = _blocks(small.drop("bands"), fields)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, left, right in zip(*[batch.column(c) for c in ("a", "b", "left", "right")], strict=True):
                same = a.as_py() == b.as_py()
                rows, tiles = _tiles(left.as_buffer(), fields)
                others, facing = (rows, tiles) if same else _tiles(right.as_buffer(), fields)
                for p, x in enumerate(tiles):
                    for y in facing[p:] if same else facing:
                        for i, j in _near(x, y, fields, threshold):
                            if x is y:
                                i, j = i[i < j], j[i < j]
                            if x.group is not None:
                                apart = x.group[i - x.at] != y.group[j - y.at]
                                i, j = i[apart], j[apart]
                            for at in range(0, len(i), 1 << 16):
                                some = (rows, i[at : at + (1 << 16)]), (others, j[at : at + (1 << 16)])
                                ids = [of["id"].chunk(0).take(pa.array(which)) for of, which in some]
                                yield pa.RecordBatch.from_arrays(ids, ["x", "y"])

    a = blocks.select(F.col("block").alias("a"), F.col("data").alias("left"))
    b = blocks.select(F.col("block").alias("b"), F.col("data").alias("right"))
    # Each pair of blocks meets once, as often in one order as in the other.
    turn = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), F.lit(2)) == 0
    once = (F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) == turn)
    met = a.join(b.hint("shuffle_replicate_nl"), once).mapInArrow(compare, f"x {id_type}, y {id_type}")
    pairs = met.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))
    # Rows of one id may meet under several masks.
    return pairs.where(F.col("left_id") < F.col("right_id")).distinct()


def candidate_pairs(table: DataFrame, least: float) -> DataFrame:
    """All pairs ``(left_id, right_id)`` whose gate words may reach Jaccard ``least``.

    Exact: a pair that reaches it is never missed, see :func:`_placed_keys`. The
    number of pairs met on a hot word grows with the square of its records;
    :func:`match_links` avoids that where only clusters are wanted.
    """
    rare = cut_lineage(_rare_words(table, least))
    return _meetings(rare, rare, F.col("a.id") < F.col("b.id"))


def attach(pairs: DataFrame, values: DataFrame, key: str, other: str) -> DataFrame:
    """Pairs with the columns of ``values (key, …)``, however many pairs one key has.

    A key with many pairs is sent to a place for each ``PAIRS_PLACE`` of them.
    """
    counts = pairs.groupBy(key).agg(F.count("*").alias("_n")).withColumn("_of", F.col("_n"))
    place = F.pmod(F.xxhash64(other), F.floor((F.col("_of") - 1) / PAIRS_PLACE) + 1)
    numbered = lookup(pairs, counts, [key], "_n", other).withColumn("_at", place).drop("_of")
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / PAIRS_PLACE)))
    spread = values.join(counts.select(key, places.alias("_at")), key)
    return numbered.join(spread, [key, "_at"]).drop("_at")


def score_all(pairs: DataFrame, table: DataFrame, fields: Sequence[Field], threshold: float) -> DataFrame:
    """The pairs whose score reaches ``threshold``, with it."""
    # Lists of words travel as one text.
    left = table.select(F.col("id").alias("left_id"), _packed("v", fields).alias("l"))
    right = table.select(F.col("id").alias("right_id"), _packed("v", fields).alias("r"))
    # Many records may be compared with one lowest id.
    both = attach(pairs, left, "left_id", "right_id").join(right, "right_id")
    both = both.withColumns({side: _unpacked(side, fields) for side in ("l", "r")})
    scored = with_score(both, fields).where(F.col("score") >= threshold)
    return scored.select("left_id", "right_id", "score")


def score_pairs(
    pairs: DataFrame,
    table: DataFrame,
    fields: Sequence[Field],
    gate: str,
    least: float,
    threshold: float,
) -> DataFrame:
    """The candidate pairs that match, with their score."""
    left = table.select(F.col("id").alias("left_id"), F.col("words").alias("lw"))
    right = table.select(F.col("id").alias("right_id"), F.col("words").alias("rw"))
    both = F.size("lw") + F.size("rw")
    # The gate test needs the words only; the other values follow for the few
    # pairs that pass.
    passed = (
        pairs.join(left, "left_id")
        .join(right, "right_id")
        .select(
            "left_id",
            "right_id",
            both.alias("both"),
            _once(F.size(F.array_intersect("lw", "rw"))).alias("common"),
        )
        .withColumn("gate", F.try_divide(F.col("common"), F.col("both") - F.col("common")))
        .where(F.col("gate") >= least)
    )
    left = table.select(F.col("id").alias("left_id"), F.col("v").alias("l"))
    right = table.select(F.col("id").alias("right_id"), F.col("v").alias("r"))
    known = {f.name: F.col("gate") for f in fields if f.name == gate and f.comparator == "words"}
    scored = with_score(passed.join(left, "left_id").join(right, "right_id"), fields, known)
    return scored.where(F.col("score") >= threshold).select("left_id", "right_id", "score")


def similar_pairs(
    table: DataFrame,
    fields: Sequence[Field] = DEFAULT_FIELDS,
    gate: str = "title",
    least: float | None = 0.5,
    threshold: float = 0.5,
    same: DataFrame | None = None,
) -> DataFrame:
    """``(left_id, right_id, score)`` of the pairs that match.

    A pair matches when the gate words reach Jaccard ``least`` and the score
    over all fields reaches ``threshold``; with None for ``least`` the score
    alone decides, and pairs are found by all fields, see :func:`near_pairs`.
    Give it :func:`variants`, or as ``same`` what :func:`variants` takes: copies
    are linked by their identity, not compared.
    """
    if least is not None:
        single = table if same is None else variants(table, same)
        return score_pairs(candidate_pairs(single, least), single, fields, gate, least, threshold)
    if threshold <= 0:
        raise ValueError("without a gate the threshold has to be above 0")
    small = sketched(table, fields, threshold, None if same is None else _copies(same))
    return score_all(cut_lineage(near_pairs(small, fields, threshold)), table, fields, threshold)


def _score_links(
    table: DataFrame, fields: Sequence[Field], threshold: float, same: DataFrame | None
) -> DataFrame:
    """:func:`match_links` where the score alone decides."""
    small = cut_lineage(sketched(table, fields, threshold, None if same is None else _copies(same)))

    def scored(pairs: DataFrame) -> DataFrame:
        matched = score_all(cut_lineage(pairs), table, fields, threshold)
        return cut_lineage(matched.select(F.col("right_id").alias("src"), F.col("left_id").alias("dst")))

    banded = small.select("id", F.explode("bands").alias("band"))
    lowest = banded.groupBy("band").agg(F.count("*").alias("rows"), F.min("id").alias("left_id"))
    met = lookup(banded, lowest.where(F.col("rows") > 1), ["band"], "rows", "id", how="inner")
    stars = met.where(F.col("left_id") < F.col("id")).select("left_id", F.col("id").alias("right_id"))
    star_links = scored(stars.distinct())
    joined = connected_components(star_links)
    placed = small.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return star_links.unionByName(scored(near_pairs(placed, fields, threshold)))


def match_links(
    table: DataFrame,
    fields: Sequence[Field],
    gate: str,
    least: float | None,
    threshold: float,
    same: DataFrame | None = None,
) -> DataFrame:
    """Links ``(src, dst)`` that give the same clusters as all matching pairs.

    Records with the same rare word are first compared with the lowest id among
    them only. Whatever that joins needs no further comparison, so in a family
    of near copies the number of comparisons grows with its size, not with its
    square. Then records meet on all their words, except where both belong to
    the cluster around a word. None for ``least``, and ``same``: see
    :func:`similar_pairs`; records that agree in minima of their sets are linked
    first, then all pairs of two clusters are compared.
    """
    if least is None:
        if threshold <= 0:
            raise ValueError("without a gate the threshold has to be above 0")
        return _score_links(table, fields, threshold, same)
    table = table if same is None else cut_lineage(variants(table, same))
    rare = cut_lineage(_rare_words(table, least))
    columns = ("id", "n", "most", "need", "own")

    def scored(pairs: DataFrame) -> DataFrame:
        matched = score_pairs(pairs, table, fields, gate, least, threshold)
        return cut_lineage(
            matched.select(F.col("right_id").alias("src"), F.col("left_id").alias("dst"))
        )

    words = rare.groupBy("word").agg(F.count("*").alias("rows"), F.min(F.struct(*columns)).alias("a"))
    shared = cut_lineage(words.where(F.col("rows") > 1))
    ordered = F.col("a.id") < F.col("b.id")
    met = lookup(rare, shared, ["word"], "rows", "id", how="inner").select("a", F.struct(*columns).alias("b"))
    star_links = scored(_enough(met.where(ordered & _may_match())))
    joined = connected_components(star_links)
    placed = rare.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # With two rows the word's only pair was met already, but maybe on too few words.
    centre = (
        shared.select("word", "rows", F.col("a.id").alias("id"))
        .join(joined, "id", "left")
        .select("word", "rows", F.coalesce("component", "id").alias("centre"))
    )
    known = lookup(placed, centre, ["word"], "rows", "id", how="inner")
    known = cut_lineage(known.withColumn("inside", F.col("component") == F.col("centre")).drop("centre"))
    apart = F.col("a.component") != F.col("b.component")
    rule = apart & (F.col("b.inside") | ordered)
    rest = _meetings(known.where(~F.col("inside")), known, rule)
    return star_links.unionByName(scored(rest))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)``: lowest id reachable over ``edges (src, dst)``.

    Alternating large-star and small-star steps: every step moves the links of
    a node to the lowest node it knows, until each node links to the lowest one
    of its component. Only partial minima and equi-joins, no neighbour lists.
    """
    links = edges.select(
        F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")
    ).where(F.col("high") != F.col("low"))
    links = cut_lineage(links.distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        lowest = both.groupBy("high").agg(F.min("low").alias("m"), F.count("*").alias("n"))
        lowest = lowest.select("high", F.least("high", "m").alias("m"), "n")
        # Large star: the higher neighbours of a node link to its lowest one.
        upward = both.where(F.col("low") > F.col("high"))
        large = lookup(upward, lowest, ["high"], "n", "low", how="inner").select(
            F.col("low").alias("high"), F.col("m").alias("low")
        )
        # Small star: the lower neighbours of a node, and itself, link to the lowest one.
        least_low = large.groupBy("high").agg(F.min("low").alias("m"), F.count("*").alias("n"))
        small = (
            lookup(large, least_low, ["high"], "n", "low")
            .select(F.explode(F.array("low", "high")).alias("high"), F.col("m").alias("low"))
            .where(F.col("high") != F.col("low"))
            .distinct()
        )
        links = cut_lineage(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("high").alias("id"), F.col("low").alias("component"))


def clusters(
    records: DataFrame, edges: DataFrame, id_col: str = "record_id", dense: bool = True
) -> DataFrame:
    """Every record with its ``cluster_id``; records without a match stand alone.

    The cluster id is the dense rank of the lowest member id, or that id itself.
    """
    members = connected_components(edges)
    joined = records.join(members.withColumnRenamed("id", id_col), id_col, "left").withColumn(
        "component", F.coalesce("component", id_col)
    )
    if not dense:
        return joined.withColumnRenamed("component", "cluster_id")
    sizes = joined.groupBy("component").agg(F.count("*").alias("n"))
    numbered = id_index(sizes, "component", "cluster_id")
    return lookup(joined, numbered, ["component"], "n", id_col).drop("component")


def with_confidence(
    clustered: DataFrame, bags: DataFrame, id_col: str = "record_id"
) -> DataFrame:
    """Add ``confidence``: Dice similarity of a record's words with its cluster's.

    ``bags (id, bag)`` holds the distinct words of each record. The confidence
    is twice the words shared with all members, over the words on both sides of
    those comparisons: 1 for equal members and for a record alone. Word counts
    per cluster replace the comparison of all members with each other.
    """
    placed = clustered.select(F.col(id_col).alias("id"), "cluster_id")
    members = placed.groupBy("cluster_id").agg(F.count("*").alias("n"))
    members = members.where(F.col("n") > 1).withColumn("members", F.col("n"))
    several = lookup(placed, members, ["cluster_id"], "n", "id", how="inner")
    worded = cut_lineage(several.join(bags, "id").where(F.size("bag") > 0))
    total = worded.groupBy("cluster_id").agg(
        F.sum(F.size("bag")).alias("total"), F.count("*").alias("n")
    )
    words = worded.select("id", "cluster_id", "members", F.explode("bag").alias("word"))
    frequency = words.groupBy("cluster_id", "word").agg(F.count("*").alias("n"))
    frequency = frequency.withColumn("f", F.col("n"))
    counted = lookup(words, frequency, ["cluster_id", "word"], "n", "id")
    shared = counted.groupBy("cluster_id", "id", "members").agg(
        F.sum("f").alias("shared"), F.count("*").alias("own")
    )
    scored = lookup(shared, total, ["cluster_id"], "n", "id").select(
        F.col("id").alias(id_col),
        F.try_divide(
            2 * F.col("shared"), F.col("own") * F.col("members") + F.col("total")
        ).alias("confidence"),
    )
    return clustered.join(scored, id_col, "left").withColumn(
        "confidence", F.coalesce("confidence", F.lit(1.0))
    )


def word_bags(table: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """``(id, bag)``: the distinct words of all compared fields."""
    lists = [
        F.col(f"v.{f.name}") if f.comparator == "words" else tokens(F.col(f"v.{f.name}"))
        for f in fields
    ]
    known = [F.coalesce(words, F.array().cast("array<string>")) for words in lists]
    return table.select("id", F.array_distinct(F.concat(*known)).alias("bag"))


def resolve(
    records: DataFrame,
    fields: Sequence[Field] = DEFAULT_FIELDS,
    gate: str = "title",
    least: float | None = 0.5,
    threshold: float = 0.5,
    id_col: str = "record_id",
) -> DataFrame:
    """Cluster records: adds ``cluster_id`` and ``confidence`` to every row.

    With None for ``least`` no pair that reaches ``threshold`` is left out.
    """
    table = comparable(records, fields, gate, id_col)
    same = identity_groups(table, fields)
    matches = match_links(table, fields, gate, least, threshold, same)
    edges = same.select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(matches)
    clustered = cut_lineage(clusters(records.select(id_col), edges, id_col))
    placed = cut_lineage(with_confidence(clustered, word_bags(table, fields), id_col))
    return records.join(placed, id_col)


def label_candidates(pairs: DataFrame, count: int, boundary: float = 0.5) -> DataFrame:
    """The pairs nearest to the decision boundary, to be labelled next."""
    distance = F.round(F.abs(F.col("score") - boundary), 9)
    return pairs.orderBy(distance, "left_id", "right_id").limit(count)


def url_relevance(url: Column | str) -> Column:
    """2 for a page of its own, 1 for a DOI link, 0 for none."""
    link = F.col(url) if isinstance(url, str) else url
    return (
        F.when(link.isNull() | link.isin("", "N/A"), 0)
        .when(F.contains(link, F.lit("doi.org")), 1)
        .otherwise(2)
    )


def golden_records(clustered: DataFrame, id_col: str = "record_id") -> DataFrame:
    """One record per cluster, merged from its members.

    Title, authors, source, year and abstract come from the member with the
    highest confidence, the DOI is the longest one, the URL the most specific
    one. ``members`` counts them. What a cluster has any number of is in
    :func:`golden_lists`.
    """
    order = -F.col(id_col)
    best = F.struct("confidence", order)
    single = clustered.groupBy("cluster_id").agg(
        F.max_by(F.struct("title", "authors", "source", "year", "abstract"), best).alias("rep"),
        F.max_by("doi", F.struct(F.length("doi"), order)).alias("doi"),
        F.max_by("url", F.struct(url_relevance("url"), order)).alias("url"),
        F.count("*").alias("members"),
    )
    return single.select(
        "cluster_id",
        "members",
        "rep.title",
        "rep.authors",
        "rep.source",
        F.coalesce(first_non_blank("rep.abstract"), F.lit("")).alias("abstract"),
        "doi",
        "url",
        "rep.year",
        F.lit(None).cast("string").alias("include"),
    )


def listed_words(value: Column) -> Column:
    """The lower-case words of a ``;``-separated list."""
    return F.transform(F.split(value, ";"), lambda k: F.lower(strip(k)))


def golden_lists(
    clustered: DataFrame,
    id_col: str = "record_id",
    keyword_items: Callable[[Column], Column] = listed_words,
    abstract_items: Callable[[Column], Column] = F.array,
) -> DataFrame:
    """``(cluster_id, kind, ord, item)``: what the members of a cluster add up to.

    ``provenance`` names each member; ``keywords`` are the distinct ones in
    order of their first place; ``abstract`` holds the distinct abstracts of the
    other members where the representative has none. The two functions cut a
    value into its items.
    """
    row, none = F.col(id_col).alias("row"), F.lit(0).alias("at")
    provenance = clustered.select(
        "cluster_id",
        F.lit("provenance").alias("kind"),
        row,
        none,
        F.concat(
            F.lit("("), F.coalesce("filename", F.lit("")), F.lit(","), F.col(id_col), F.lit(")")
        ).alias("item"),
    )
    usable = F.when(is_usable("keywords"), F.col("keywords"))
    keywords = clustered.select(
        "cluster_id",
        F.lit("keywords").alias("kind"),
        row,
        F.posexplode(keyword_items(usable)).alias("at", "item"),
    )
    best = F.struct("confidence", -F.col(id_col))
    gaps = clustered.groupBy("cluster_id").agg(
        F.max_by("abstract", best).alias("own"), F.count("*").alias("n")
    )
    gaps = gaps.where(~is_usable("own")).select("cluster_id", "n", F.lit(True).alias("gap"))
    told = clustered.where(is_usable("abstract")).select("cluster_id", id_col, "abstract")
    abstracts = lookup(told, gaps, ["cluster_id"], "n", id_col, how="inner").select(
        "cluster_id",
        F.lit("abstract").alias("kind"),
        row,
        F.posexplode(abstract_items(F.col("abstract"))).alias("at", "item"),
    )
    # Equal items of a cluster keep their first place; provenance has none.
    firsts = (
        keywords.unionByName(abstracts)
        .groupBy("cluster_id", "kind", "item")
        .agg(F.min(F.struct("row", "at")).alias("first"))
        .select("cluster_id", "kind", "first.row", "first.at", "item")
    )
    items = cut_lineage(provenance.unionByName(firsts))
    return ordered_items(items, ["cluster_id", "kind"], ["row", "at"]).select(
        "cluster_id", "kind", "ord", "item"
    )


def golden_table(clustered: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Golden records with their lists as joined texts, where those fit one value."""
    lists = golden_lists(clustered, id_col)
    table = golden_records(clustered, id_col)
    for kind, separator in (("provenance", "; "), ("keywords", "; "), ("abstract", "\n")):
        own = lists.where(F.col("kind") == kind)
        table = table.join(joined_items(own, ["cluster_id"], separator, f"_{kind}"), "cluster_id", "left")
    told = F.when(is_usable("abstract"), F.col("abstract"))
    return table.select(
        "cluster_id",
        F.coalesce("_provenance", F.lit("")).alias("source_database_indices"),
        "title",
        "authors",
        F.coalesce("_keywords", F.lit("")).alias("keywords"),
        "source",
        F.coalesce(told, F.col("_abstract"), F.col("abstract")).alias("abstract"),
        "doi",
        "url",
        "year",
        "include",
    )


def labelled_pairs_model(
    pairs: DataFrame, fields: Sequence[Field] = DEFAULT_FIELDS
) -> tuple[list[str], object]:
    """Fit field weights on labelled pairs ``(l, r, is_match)``.

    ``l`` and ``r`` are structs of compared fields as :func:`compared_fields`
    builds them. Returns the feature names and the fitted Spark ML model.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    featured = pair_features(pairs, fields)
    names = [f"{f.name}_score" for f in fields] + [f"{f.name}_absent" for f in fields]
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(featured)
    model = LogisticRegression(labelCol="is_match", maxIter=50, regParam=0.01).fit(assembled)
    return names, model


def pair_features(pairs: DataFrame, fields: Sequence[Field] = DEFAULT_FIELDS) -> DataFrame:
    """Add a score and an absence flag per field to pairs with ``l`` and ``r``."""
    columns = {}
    for f in fields:
        s = _field_score(f, F.col(f"l.{f.name}"), F.col(f"r.{f.name}"))
        columns[f"{f.name}_score"] = F.coalesce(s, F.lit(0.0))
        columns[f"{f.name}_absent"] = s.isNull().cast("double")
    return pairs.withColumns(columns)


def model_scores(pairs: DataFrame, names: list[str], model, fields: Sequence[Field] = DEFAULT_FIELDS) -> DataFrame:
    """Match probability of pairs by a fitted model, in ``score``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    featured = VectorAssembler(inputCols=names, outputCol="features").transform(
        pair_features(pairs, fields)
    )
    scored = model.transform(featured).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*pairs.columns, "score")
