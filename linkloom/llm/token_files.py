"""Token ids in flat binary files.

Texts are encoded where they are read, once; what is shuffled are packed ids. Documents are dealt by
range of (id, text hash, row number), ascending, so equal ids stay in order and even a hot id spreads
over tasks. The ranges' ends come from a sample of these keys alone, ``SAMPLE`` a partition and ``MOST`` in
all; they place the cuts between files and nothing else. Each partition writes three flat files: ``tokens`` (unsigned
integers, 16 bits where the vocabulary fits, else 32), ``offsets`` (unsigned 64-bit, one more than
documents, counted from the partition's first token) and ``ids`` (signed 64-bit; null ids come
first, their number is in the manifest). A manifest row names each partition's files. The base of a
partition is the prefix sum of the token counts before it, so the place of a document in the whole
sequence is base plus offset; no task needs another's data. Readers, one task per partition, map the
files, or read them by ranges where the store isn't local.

Encoding: texts are cut at ASCII white space, which the tokenizer drops anyhow and no token spans;
each distinct word goes through the tokenizer library once per worker and its packed ids are kept,
up to ``WORDS`` words (about 200 bytes each). The tokenizer lower-cases, so A-Z are lowered first; not
so in texts with combining marks, where composing before or after lowering may differ, nor in words
that hold an added token's text in any case, as added tokens are matched before lowering. Words that are
Latin letters in lower case, with ASCII marks (no apostrophe) after them, skip the tokenizer's
splitting: letters and marks are separate pieces to it in any case, and its merging model takes each.

Defined cases: null and empty texts have only the end id; equal ids keep the order of their text
hashes; repeated rows are all written; other columns, whatever their names, are ignored; an empty
table writes an empty manifest. Files of lost attempts are never named in the manifest.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm import files, worker
from linkloom.llm.store import Tables, new_path

WORDS, SAMPLE, MOST, _PART, _ROWS = 1_200_000, 100, 1_000_000, 512, 10_000
MANIFEST = "part int, tokens string, offsets string, ids string, n_docs long, n_null long, n_tokens long, width int"


def words_of(data: bytes, added: tuple[bytes, ...] = ()) -> list[bytes]:
    """The words of a text, in lower case where that is sure to change no id; added are the added tokens' texts in lower case."""
    if b"\xcc" in data or b"\xcd" in data:  # lead bytes of U+0300 to U+036F
        return data.split()
    low = data.lower()
    if any(x in low for x in added):
        return [w if any(x in w.lower() for x in added) else w.lower() for w in data.split()]
    return low.split()


#: Letters below U+0250 (all composed already, none is white space or a mark), then ASCII marks.
_LATIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_names() -> dict[int, str]:
    """The byte alphabet of byte-level models: visible characters stand for themselves, the others for those from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(visible)]
    return {x: chr(x) for x in visible} | {x: chr(256 + n) for n, x in enumerate(hidden)}


class WordEncoder(dict):
    """ASCII-blank-separated word to its packed ids."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added = tuple(t.content.encode().lower() for t in self.model.get_added_tokens_decoder().values())
        self.merge, self.names, self.tails = self.model.model.tokenize, _byte_names(), {"": b""}

    def _split(self, words: list[str]) -> list[bytes]:
        """Packed ids of words by the whole tokenizer."""
        coded = self.model.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(coded.ids, self.dtype)
        of = np.array(coded.word_ids, np.int64) if len(ids) else np.zeros(0, np.int64)
        cuts = np.searchsorted(of, np.arange(len(words) + 1)) * self.dtype.itemsize
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _core(self, letters: str) -> bytes:
        size = self.dtype.itemsize
        name = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.names)
        return b"".join([t.id.to_bytes(size, "little") for t in self.merge(name)])

    def learn(self, words: set[bytes]) -> None:
        """Encode words not met before."""
        if len(self) + len(words) > WORDS:
            self.clear()
        others = []
        for word in words:
            if word in self:
                continue
            text = word.decode()
            m = _LATIN.fullmatch(text)
            if m is None or text.lower() != text:
                others.append(word)
                continue
            core, tail = m.groups()
            if tail not in self.tails:
                if len(self.tails) > 100_000:
                    self.tails = {"": b""}
                self.tails[tail] = self._split([tail])[0]
            known = self.get(core.encode()) if tail else None
            self[word] = (self._core(core) if known is None else known) + self.tails[tail]
        for at in range(0, len(others), 10_000):
            part = others[at : at + 10_000]
            self.update(zip(part, self._split([w.decode() for w in part]), strict=True))

    def encode(self, words: list[bytes]) -> bytes:
        """Packed ids of words that have been learnt."""
        return b"".join(map(self.__getitem__, words))


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, one per worker process."""
    return worker.keep(("words", path), lambda: WordEncoder(path))


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select("text", F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))


def _range_ends(rows: DataFrame, n: int) -> list[tuple]:
    """The keys that end all of n ranges but the last, from a sample."""
    share = min(1.0, min(SAMPLE * n, MOST) / max(rows.count(), 1))
    some = sorted(map(tuple, _keys(rows).select("known", "id", "h", "row").sample(share, 42).collect()))
    return [some[k * len(some) // n] for k in range(1, n)] if some else []


def _encoded(rows: DataFrame, path: str, end_id: int, ends: list[tuple]) -> DataFrame:
    """(range, known, id, h, ids): of rows (id, text) the packed ids of each text with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(path)
        end = np.array([end_id], own.dtype).tobytes()
        for few in (b.slice(at, _PART) for b in batches for at in range(0, b.num_rows, _PART)):
            words = [words_of(x.as_buffer().to_pybytes(), own.added) if x.is_valid else [] for x in few.column(0).cast(pa.binary())]
            own.learn(set().union(*words))
            packed = [own.encode(each) + end for each in words]
            places = [bisect_right(ends, key) for key in zip(*(few.column(k).to_pylist() for k in range(1, 5)), strict=True)]
            ids = pa.array(packed, pa.large_binary() if sum(map(len, packed)) >> 31 else pa.binary())
            yield pa.record_batch([pa.array(places, pa.int32()), *few.columns[1:4], ids], ["range", "known", "id", "h", "ids"])

    return _keys(rows).mapInArrow(run, "range int, known boolean, id long, h long, ids binary")


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts and return the manifest, with ``base`` the tokens before each partition."""
    files.make_dir(folder)
    tables = Tables(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, size = TaskContext.get().partitionId(), word_encoder(path).dtype.itemsize
        n_docs = n_null = n_tokens = 0
        names = [f"{kind}-{part:06d}" for kind in ("tokens", "offsets", "ids")]
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with files.writer(folder, names[0]) as (tokens_at, tokens), files.writer(folder, names[1]) as (offsets_at, offsets), files.writer(folder, names[2]) as (ids_at, ids):
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in chain([first], batches):
                lengths = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64) // size
                for packed in batch.column(2):
                    tokens.write(packed.as_buffer())
                offsets.write((n_tokens + np.cumsum(lengths)).astype("<u8").tobytes())
                ids.write(batch.column(1).to_numpy().astype("<i8").tobytes())
                n_docs, n_null, n_tokens = n_docs + batch.num_rows, n_null + batch.num_rows - pc.sum(batch.column(0)).as_py(), n_tokens + int(lengths.sum())
        yield pa.RecordBatch.from_pylist([{"part": part, "tokens": tokens_at, "offsets": offsets_at, "ids": ids_at, "n_docs": n_docs, "n_null": n_null, "n_tokens": n_tokens, "width": size}], schema=_SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _encoded(rows, path, end_id, _range_ends(rows, n)).repartitionById(n, "range").sortWithinPartitions("known", "id", "h").select("known", "id", "ids")
    manifest = tables.write(dealt.mapInArrow(run, MANIFEST), "manifest")  # one row per partition
    return manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


_SCHEMA = pa.schema([("part", pa.int32()), ("tokens", pa.string()), ("offsets", pa.string()), ("ids", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the mapped files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with files.reader(row["tokens"]) as tokens, files.reader(row["offsets"]) as offsets, files.reader(row["ids"]) as ids:
                    n, width, last = row["n_docs"], row["width"], -1
                    if (tokens.size(), offsets.size(), ids.size()) != (row["n_tokens"] * width, 8 * n + 8, 8 * n):
                        raise ValueError(f"token files of partition {row['part']} are damaged")
                    for at in range(0, n, _ROWS):
                        some = np.frombuffer(files.range_of(ids, 8 * at, 8 * min(_ROWS, n - at)), "<i8")
                        cut = np.frombuffer(files.range_of(offsets, 8 * at, 8 * len(some) + 8), "<u8").astype(np.int64)
                        if last not in (-1, cut[0]) or cut[0] != 0 and last == -1 or np.diff(cut).min() < 0 or at + _ROWS >= n and cut[-1] != row["n_tokens"]:
                            raise ValueError(f"offsets of partition {row['part']} are damaged")
                        last = int(cut[-1])
                        flat = np.frombuffer(files.range_of(tokens, int(cut[0]) * width, (last - int(cut[0])) * width), f"<u{width}")
                        crcs = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip((cut[:-1] - cut[0]).tolist(), (cut[1:] - cut[0]).tolist(), strict=True)]
                        yield pa.record_batch([pa.array(some, mask=np.arange(at, at + len(some)) < row["n_null"]), pa.array(row["base"] + cut[:-1]), pa.array(np.diff(cut)), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    n = manifest.count()  # rows of a small written table; a given number of partitions isn't coalesced, so each file has its own task
    return manifest.repartitionByRange(max(n, 1), "part").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write all texts below the shared folder, read the files back."""
    return read_token_files(write_token_files(docs, new_path(docs.sparkSession, "token-files"), path, end_id))
