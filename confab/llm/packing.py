"""Cost-balanced packing of tokenised documents into training sequences.

A document's ids are cut every ``capacity`` ids. Pieces are dealt to groups of ``GROUP`` pieces on average at most (a text has no
more ids than bytes, which bounds its pieces before it is tokenised) by a hash of what and where they are, and each group is
packed by itself: pieces in descending length, each into the sequence of lowest cost that has room,
where a sequence's cost is its length times ``LINEAR`` plus ``QUADRATIC`` times the sum of its pieces' squared lengths
(attention within a document). A piece that no open sequence has room for is the only one that opens a further sequence.

Only lengths and checksums are shuffled; ids are made once, in the task that reads the text. A group is bounded, so is the
memory of its task. Groups are independent and deterministic, so a lost executor's groups are simply packed again.

Defined cases: a null text is empty and yields the closing id alone; repeated rows are packed once each; an empty table
gives no pieces.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import common

CAPACITY = 2048
#: Pieces in a group, on average.
GROUP = 8192
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
CLOSING_ID = 1
#: A worker keeps the ids of parts over all its tasks: twice half of this and the parts of a slice, at most; some 220 MB.
CACHE = 1_000_000


#: Texts that show whether a vocabulary's ids are those of lower-cased, blank-separated parts.
PROBES = ["Hello WORLD a  b", " x\ny\n", "A B\tC", "don't  STOP,now", "it is\nso \n\n x1", "é Ü ß a"]
#: Parts that show whether it tells a word from the signs around it, and marks the end of a word.
SIGNED = ["it,", "(so)", "**été**", "$a", "über...", "[Unworthinesses]:", "x", "ÀÇÑ!", "\"ñoño\"", "#b;"]
#: A word of ASCII and Latin-1 letters between signs. An apostrophe may belong to what follows it.
WORD = re.compile("([!-&(-/:-@\\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
WORD_END = "</w>"
BEYOND = re.compile("[^\x00-\xff]")


class Ids:
    """Ids of texts as little-endian bytes.

    Where a vocabulary drops white space and never joins across it, the ids of a text are those of its blank-separated parts
    on end, and each distinct part is encoded once and then looked up. ``PROBES`` show whether that holds, and whether case
    matters; where it does not hold, texts are encoded as they are.

    Words are encoded many in a line, cut apart where ids end a word, and signs around them by themselves, if ``SIGNED`` shows
    that this gives the same ids. Parts that were used since half the cache was filled are kept, so a long tail of rare ones does
    not drive out those that most of a text is made of. Parts with a sign that begins an added token are encoded as they are.
    """

    def __init__(self, path: str, keep: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first = {t[:1].lower() for t in self.added} | {t[:1].upper() for t in self.added}
        self.signs: dict[str, bytes] = {"": b""}
        self.words = bool(self.ends.any()) and not any(c.isalpha() for c in self.first) and self.by_words(SIGNED) == self.encoded(SIGNED)
        plain = self.encoded(PROBES)
        self.folds, self.parts = True, True
        if self(PROBES) != plain:
            self.folds, self.known, self.older = False, {"": b""}, {}
            self.parts = self(PROBES) == plain

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def by_words(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without blanks."""
        found = [WORD.fullmatch(p) for p in parts]
        found = [m if m and ((not m[1] and not m[3]) or self.first.isdisjoint(m[1] + m[3])) else None for m in found]
        words = list({m[2] for m in found if m})
        got: dict[str, bytes] = {}
        for at in range(0, len(words), 256):
            line = words[at : at + 256]
            ids = self.encoded([" ".join(line)])[0]
            array = np.frombuffer(ids, "<u4")
            to = (np.flatnonzero(self.ends[np.minimum(array, len(self.ends) - 1)]) + 1) * 4
            if len(to) != len(line) or to[-1] != len(ids):
                got.update(zip(line, self.encoded(line), strict=True))
                continue
            begin = 0
            for word, end in zip(line, to.tolist(), strict=True):
                got[word] = ids[begin:end]
                begin = end
        other = [p for p, m in zip(parts, found, strict=True) if not m]
        rest = iter([b for at in range(0, len(other), 4096) for b in self.encoded(other[at : at + 4096])])
        return [self.sign(m[1]) + got[m[2]] + self.sign(m[3]) if m else next(rest) for m in found]

    def sign(self, signs: str) -> bytes:
        if len(signs) > 8:
            return self.encoded([signs])[0]
        if signs not in self.signs:
            if len(self.signs) > 1000:
                self.signs = {"": b""}
            self.signs[signs] = self.encoded([signs])[0]
        return self.signs[signs]

    def folded(self, text: str) -> str:
        """The text in lower case, which makes parts fewer; as it is beyond Latin-1, where the order of steps could matter, or if an added token would arise."""
        if not (text.isascii() or not BEYOND.search(text)):
            return text
        low = text.lower()
        return text if any(t in low for t in self.added) else low

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.parts:
            return [b for at in range(0, len(texts), 256) for b in self.encoded(texts[at : at + 256])]
        parts = [(self.folded(t) if self.folds else t).replace("\n", " ").split(" ") for t in texts]
        wanted = set().union(*parts).difference(self.known) if parts else set()
        if len(self.known) > self.keep // 2:
            self.older, self.known = self.known, {"": b""}
            wanted = set().union(*parts).difference(self.known)
        new = []
        for p in wanted:
            if (ids := self.older.get(p)) is None:
                new.append(p)
            else:
                self.known[p] = ids
        if self.words:
            self.known.update(zip(new, self.by_words(new), strict=True))
        else:
            for at in range(0, len(new), 4096):
                self.known.update(zip(new[at : at + 4096], self.encoded(new[at : at + 4096]), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]


@functools.cache
def encoder(path: str, keep: int) -> Ids:
    """One for each worker process, so that later tasks find what earlier ones encoded."""
    return Ids(path, keep)


def pieces(docs: DataFrame, *, vocabulary: str, id_col: str, text_col: str, capacity: int, with_ids: bool, keep: int = CACHE, stay: bool = True) -> DataFrame:
    """A row per piece: the document's id, start, length, ids_crc32, doc_tokens and, if asked for, ids.

    stay: a worker keeps the vocabulary and the encoded parts for its later tasks; else they go with each task.
    """
    close = np.array([CLOSING_ID], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, keep) if stay else Ids(vocabulary, keep)
        for batch in batches:
            for part in common.slices(batch, text_col):
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, got in enumerate(encode([t or "" for t in part.column(text_col).to_pylist()])):
                    got += close
                    n = len(got) // 4
                    for at in range(0, n, capacity):
                        piece = got[4 * at : 4 * (at + capacity)]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                cols = [part.column(id_col).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])
        encode = None
        common.give_back()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of a group. lengths must descend.

    Sequences wait in a heap by cost. One without room for the piece at hand is parked by the room it has, and comes back
    when pieces have become small enough for it.
    """
    n = len(lengths)
    seq, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    need = max(1, -(-int(lengths.sum()) // capacity)) if n else 0
    used = [0] * need
    cost = [0.0] * need
    open_ = [(0.0, s) for s in range(need)]
    parked: list[tuple[int, int]] = []  # (-room, sequence)
    for i, size in enumerate(lengths.tolist()):
        while parked and -parked[0][0] >= size:
            s = heapq.heappop(parked)[1]
            heapq.heappush(open_, (cost[s], s))
        while open_ and capacity - used[open_[0][1]] < size:
            s = heapq.heappop(open_)[1]
            if used[s] < capacity:
                heapq.heappush(parked, (used[s] - capacity, s))
        if open_:
            s = heapq.heappop(open_)[1]
        else:
            s = len(used)
            used.append(0)
            cost.append(0.0)
        seq[i], offset[i] = s, used[s]
        used[s] += size
        cost[s] += linear * size + quadratic * size * size
        heapq.heappush(open_, (cost[s], s))
    return seq, offset


def pack_documents(
    docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    group: int = GROUP, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False, keep: int = CACHE, stay: bool = True,
) -> DataFrame:
    """A row per piece: the document's id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id and offset."""
    cut = pieces(docs, vocabulary=vocabulary, id_col=id_col, text_col=text_col, capacity=capacity, with_ids=with_ids, keep=keep, stay=stay)
    most = docs.agg(F.count("*") + F.coalesce(F.sum(F.expr(f"octet_length({quoted(text_col)}) div {capacity}")), F.lit(0))).first()[0]
    groups = max(1, -(-most // group))
    # The row's number spreads rows that are repeated.
    cut = cut.withColumn("_group", F.pmod(F.xxhash64(id_col, "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    names = [*cut.columns[:-1], "sequence_id", "offset"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id_col, "start"], ascending=[False, True, True], kind="stable")
        seq, offset = assign(pdf["length"].to_numpy(), capacity, linear, quadratic)
        return pdf.assign(sequence_id=(int(key[0]) << 24) + seq, offset=offset)[names]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields[:-1]) + ", sequence_id long, offset long"
    return cut.groupBy("_group").applyInPandas(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised with the word-level public vocabulary."""
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))
