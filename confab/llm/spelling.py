"""Spelling variants by rolling-hash deletions: words one edit apart meet under the hash of a string with one letter deleted.

Words are runs of Latin letters, so a code point is one byte in Latin-1 and all work is on flat arrays of bytes. Prefix and suffix
sums of a polynomial hash give the key of a word, and of the word less each of its letters, without building the strings.
Keys are dealt out by their top bits (a radix partition: mixed keys are uniform) and sorted there. Of the rows of a key

* two that delete the same place of their words are words that differ by a replacement there;
* a whole word and those that become it by a deletion differ by an insertion.

So a key needs no pairs: a group of replacements tells each member how many others there are and the best of them (the most
frequent two are enough for all), and a whole word is the centre of a star. An alphabet of 90 letters bounds the rows of a key
at some 90 times the word's length, however large the vocabulary. The strings behind equal keys are built and compared; where
they differ (a collision of hashes) the rows are sorted by their strings too.

Forms point to words of at least ``TIMES`` their number, so a chain has some 19 steps at most, and roots are found by pointer
doubling in a few joins.

Defined cases: null and empty texts have no words; a null id counts as an empty one; repeated rows count each; of words of equal
number the smallest in code-point order is the form; a word without near words is its own root; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import common, crc, wordhash as wh

U = np.uint64
#: Fewest letters and occurrences of a word, and how many times as frequent a form is.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: One in so many distinct runs of a document loses a letter.
DAMAGE = 31
#: Top bits of a key that deal it out.
RADIX_BITS = 16
#: Distinct words that a task holds before it passes them on.
HELD = 1 << 19
#: Pointer doubling after which no chain of forms goes on: 2 ** 5 steps.
DOUBLINGS = 5


# ---- letters


def _letters() -> np.ndarray:
    """For each byte of UTF-8 the lower-cased ASCII letter, or 0."""
    out = np.zeros(256, np.uint8)
    out[0x41:0x5B] = out[0x61:0x7B] = np.arange(0x61, 0x7B)
    return out


ASCII = _letters()
#: First byte in UTF-8 of U+00C0 to U+00FF, and what its second byte lacks of the code point.
LEAD, LIFT = 0xC3, 0x40


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, first byte and end of each run of letters, each byte's letter in Latin-1 (0: none), and each run's text."""
    low = ASCII[data]
    tail = np.zeros(len(data), bool)
    tail[1:] = data[:-1] == LEAD
    lead = data == LEAD
    letter = np.where(tail, data + np.uint8(LIFT), low)
    low = np.where(tail | lead, data, low)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return low, starts, ends, letter, np.searchsorted(offsets, starts, side="right") - 1


def utf8(latin: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings from Latin-1 letters on end."""
    wide = latin >= 0x80
    size = np.cumsum(1 + wide) if len(latin) else np.zeros(0, np.int64)
    out = np.full(int(size[-1]) if len(size) else 0, LEAD, np.uint8)
    out[size - 1] = np.where(wide, latin - np.uint8(LIFT), latin)
    at = np.concatenate(([0], np.concatenate(([0], size))[ends])).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(out)])


def latin1(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 letters of all words on end, and where each begins (one entry more than words)."""
    data, offsets = common.buffers(words)
    lead = data == LEAD
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    at = np.concatenate(([0], np.cumsum(~lead)))
    return np.where(tail, data + np.uint8(LIFT), data)[~lead], at[offsets]


# ---- words of the corpus


def occurrences(texts: pa.Array, ids: list[str], damage: int, letters: int) -> pa.Array:
    """The words of some texts, one by one. ids: each text's id as text."""
    low, starts, ends, letter, owner = runs(*common.buffers(texts))
    place = np.concatenate(([0], np.cumsum(letter != 0)))
    size = place[ends] - place[starts]
    long = size >= letters
    starts, ends, owner, size = starts[long], ends[long], owner[long], size[long]
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = crc.of_runs(low, starts, ends, before[owner])
    hurt = h % np.uint32(damage) == 0
    gone = place[starts] + h % size
    keep = size - hurt >= letters
    cover = np.zeros(place[-1] + 1, np.int8)
    cover[place[starts[keep]]] += 1
    np.add.at(cover, place[ends[keep]], -1)
    inside = np.cumsum(cover[:-1], dtype=np.int8) > 0
    inside[gone[keep & hurt]] = False
    return utf8(letter[letter != 0][inside], np.cumsum((size - hurt)[keep]))


def counted(docs: DataFrame, id_col: str, text_col: str, *, damage: int = DAMAGE, letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """word and n, of every word of at least so many letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            for part in common.slices(batch, "text"):
                found = occurrences(part.column("text"), part.column("id").to_pylist(), damage, letters).value_counts()
                held.append(pa.table({"word": found.field(0).cast(pa.string()), "n": found.field(1)}))
                size += len(found)
                if size > HELD:
                    held = [summed()]
                    size = held[0].num_rows
                    if size > HELD // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from summed().to_batches()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- deletion keys


def deletion_keys(latin: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, word and place (-1: none is deleted) of every word and of every word less one letter. first: where words begin in ``latin``."""
    up, down = wh.powers(len(latin) + 1)
    total = np.zeros(len(latin) + 1, U)
    np.cumsum(latin * up[: len(latin)], dtype=U, out=total[1:])
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    begin, end, at = first[:-1], first[1:], np.arange(len(latin))
    whole = (total[end] - total[begin]) * down[begin]
    prefix = (total[at] - total[begin[owner]]) * down[begin[owner]]
    suffix = (total[end[owner]] - total[at + 1]) * down[begin[owner] + 1]
    keys = np.concatenate((wh.mix(whole + size.astype(U) * wh.LINK), wh.mix(prefix + suffix + (size[owner] - 1).astype(U) * wh.LINK)))
    return keys, np.concatenate((np.arange(len(size)), owner)), np.concatenate((np.full(len(size), -1), at - begin[owner]))


def keyed(words: DataFrame, mask: int) -> DataFrame:
    """radix, key, place, word and n. mask: bits of the keys that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                part = batch.slice(at, 1 << 16)
                key, word, place = deletion_keys(*latin1(part.column("word")))
                key = key & U(mask)
                radix = pa.array((key >> U(64 - RADIX_BITS)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([radix, pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), *(part.column(c).take(pa.array(word)) for c in ("word", "n"))], names=["radix", "key", "place", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "radix int, key long, place int, word string, n long")


def without_letter(words: pa.Array, place: np.ndarray) -> pa.Array:
    """Each word less the letter at its place (-1: the whole word)."""
    latin, first = latin1(words)
    keep = np.ones(len(latin), bool)
    hurt = place >= 0
    keep[first[:-1][hurt] + place[hurt]] = False
    return utf8(latin[keep], np.cumsum(np.diff(first) - hurt))


def heads(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it in some column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def best_two(group: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group the rows of its largest n and of its next largest (-1: none); ties go to the earlier row. group: ascending from 0."""
    order = np.lexsort((np.arange(len(n)), -n, group))
    start = np.flatnonzero(heads(group[order]))
    size = np.diff(np.append(start, len(order)))
    second = np.where(size > 1, order[np.minimum(start + 1, max(len(order) - 1, 0))], -1)
    return order[start], second


def nearby(rows: pa.Table) -> pa.Table:
    """word, near (how many near words these rows show), and the best of them with its number. rows: whole keys, by key, place and word."""
    key, place = rows.column("key").to_numpy(), rows.column("place").to_numpy()
    text = without_letter(rows.column("word").combine_chunks(), place)
    same = np.ones(len(key), bool)
    if len(key) > 1:
        same[1:] = pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
    if (~same & ~heads(key)).any():  # equal hashes of different strings
        order = pc.sort_indices(rows.append_column("text", text), [(c, "ascending") for c in ("key", "text", "place", "word")])
        rows, text = rows.take(order), text.take(order)
        key, place = rows.column("key").to_numpy(), rows.column("place").to_numpy()
        same[1:] = pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
    group = np.cumsum(heads(key) | ~same) - 1
    word, n = rows.column("word").combine_chunks(), rows.column("n").to_numpy()
    out = []

    # Words that differ at the place that both delete.
    at = np.flatnonzero(place >= 0)
    sub = np.cumsum(heads(group[at], place[at])) - 1
    size = np.bincount(sub, minlength=1)[sub] if len(at) else np.zeros(0, np.int64)
    at, sub, size = at[size > 1], sub[size > 1], size[size > 1]
    if len(at):
        sub = np.cumsum(heads(sub)) - 1
        one, two = best_two(sub, n[at])
        me = np.arange(len(at))
        out.append((at, size - 1, at[np.where(one[sub] == me, two[sub], one[sub])]))

    # A whole word, which stands first in its group, and the words that become it.
    whole = np.flatnonzero(place < 0)
    centre = np.full(group[-1] + 1 if len(group) else 0, -1)
    centre[group[whole]] = whole
    at = np.flatnonzero((place >= 0) & (centre[group] >= 0))
    if len(at):
        code = word.dictionary_encode().indices.to_numpy()
        at = at[np.unique(group[at] * np.int64(len(code)) + code[at], return_index=True)[1]]  # a letter that stands twice on end gives a word twice
        at = at[pc.sort_indices(pa.table({"g": group[at], "w": word.take(pa.array(at))}), [("g", "ascending"), ("w", "ascending")]).to_numpy()]
        hub = np.cumsum(heads(group[at])) - 1
        centres = centre[group[at[heads(group[at])]]]
        out += [(centres, np.bincount(hub), at[best_two(hub, n[at])[0]]), (at, np.ones(len(at), np.int64), centres[hub])]
    me, near, best = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"word": word.take(pa.array(me)), "near": near, "best": word.take(pa.array(best)), "best_n": n[best]})


def neighbours(words: DataFrame, *, mask: int = (1 << 64) - 1) -> DataFrame:
    """word, n_near, form and form_n of every word that has near words; form: the near word of largest n, whatever that is. words: word and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key = held.column("key").to_numpy()
            done = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if done:
                yield from nearby(held.slice(0, done)).to_batches()
                held = held.slice(done).combine_chunks()
        if held is not None:
            yield from nearby(held).to_batches()

    dealt = keyed(words, mask).repartition("radix").sortWithinPartitions("key", "place", "word").drop("radix")
    found = dealt.mapInArrow(run, "word string, near long, best string, best_n long")
    best = F.min(F.struct(F.negative("best_n").alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("form"), F.negative("b.n").alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where chains of forms end, for every word that has a form. forms: word and form."""
    now = common.cut(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(DOUBLINGS):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = common.cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = stepped.select("word", "root")
        if not stepped.where("moved").head(1):
            break
    return now


def variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE, letters: int = LETTERS, least: int = OCCURRENCES, times: int = TIMES, mask: int = (1 << 64) - 1,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts."""
    words = common.cut(counted(docs, id_col, text_col, damage=damage, letters=letters, least=least), "words")
    near = words.join(neighbours(words, mask=mask), "word", "left")
    enough = F.col("form_n") >= times * F.col("n")
    near = common.cut(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "near")
    ends = roots(near.where(F.col("form").isNotNull()))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents that is long and frequent enough, with its form and root."""
    return variants(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
with recursive bits(b, c, k) as (select range, range::uinteger, 0 from range(256) union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384::uinteger) else c >> 1 end, k + 1 from bits where k < 8),
byte as (select list(c order by b) t from bits where k = 8),
runs as (select i, w, count(*) n from (select coalesce(doc_id::varchar, '') i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) w from documents) where length(w) >= 7 group by all),
coded as (select w, n, hex(encode(i || ':' || w)) x from runs),
hashed as (select w, n, xor(4294967295::uinteger, list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::uinteger), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::integer + 1]), 4294967295::uinteger))::bigint h from coded, byte),
words as materialized (select word, sum(n)::bigint n from (select n, case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end word from hashed) where length(word) >= 7 group by word having sum(n) >= 2),
gone as materialized (select word, n, i, substr(word, 1, i) || substr(word, i + 2) x from (select word, n, unnest(range(length(word))) i from words)),
near as materialized (select a.word, b.word other, b.n from gone a join gone b on a.x = b.x and a.i = b.i and a.word <> b.word union select a.word, b.word, b.n from gone a join words b on a.x = b.word union select b.word, a.word, a.n from gone a join words b on a.x = b.word),
best as (select word, count(*) n_near, min((-n, other)) b from near group by word),
forms as materialized (select w.word, w.n, coalesce(n_near, 0) n_near, case when -b[1] >= 10 * w.n then b[2] end form, case when -b[1] >= 10 * w.n then -b[1] end form_n from words w left join best using (word)),
chain(word, root, k) as (select word, form, 1 from forms where form is not null union all select c.word, f.form, k + 1 from chain c join forms f on f.word = c.root where f.form is not null),
ends as (select word, max_by(root, k) root from chain group by word)
select word, form, coalesce(root, word) root, n, n_near, form_n from forms left join ends using (word)
"""
