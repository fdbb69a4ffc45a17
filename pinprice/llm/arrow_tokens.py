"""Token ids in Arrow files of equal-length sequences.

All documents' ids, in ascending id order and each with an end id, are packed
into sequences of ``SEQ`` ids. A file is an uncompressed Arrow IPC file whose
batches hold two fixed-size-list columns, ids (uint16 where the vocabulary
allows, else uint32) and mask (one bit per id, 0 on padding), so every sequence
is at a known place and a memory map gives it without a copy. Beside every file
lies an index file with doc_id, start and n_tokens of the documents that begin
in it.

Documents are encoded where they are read; their ids go, by range of the
document id, to the task that writes that range in order. A range is a run of
files of ``SEQS`` sequences, so memory holds one record batch, however long or
many the documents; only the end of a range is padded. Range bounds are
quantiles of the id column alone. A document's place in the whole stream is
the sum of the ranges before plus its place in its range. Files are written
under a temporary name and moved when complete, so that a repeated attempt
replaces them by the same bytes.

Defined results: a null text is empty and has the end id only; documents of
equal id follow one another in the order of their ids; a null id sorts first;
an empty table gives no files; other columns are ignored; texts that hold the
tokenizer's special strings are encoded as the library does.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinprice.llm.common import ship_package, store

SEQ, SEQS, BATCH = 2048, 512, 64  # ids per sequence, sequences per file and per record batch
CACHE = 700_000
MARKS = ".,;:!?"  # one of them behind a word of letters is a token sequence of its own
_ENCODERS: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """Ids of texts, each distinct run between ASCII white space encoded once by the library.

    The tokenizer drops white space and no rule of it looks across, so the ids
    of a text are those of its runs in order (the tests compare whole texts).
    ASCII letters are lower-cased beforehand, as its normaliser does, unless a
    special string could be meant.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.lower().encode() for t in added]
        self.ids: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.marks = {m: np.array(ids, np.uint32).tobytes() for m, ids in zip(MARKS, self._ids(list(MARKS)), strict=True)}
        self.marks[""] = b""

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        runs = []
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            low = raw.lower()
            runs.append((raw if any(s in low for s in self.special) else low).split())
        new = set().union(*runs).difference(self.ids)
        if len(self.ids) + len(new) > CACHE:
            self.ids.clear()
            new = set().union(*runs)
        self._learn(new)
        get = self.ids.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), np.uint32) for x in runs]


    def _learn(self, new: set[bytes]) -> None:
        """Encode new runs; words of letters go to the library many at a time, told apart by their last token."""
        runs = list(new)
        text = b" ".join(runs).decode("utf-8", "replace").split(" ") if runs else []
        tails = [s[-1] if s[-1] in MARKS and len(s) > 1 else "" for s in text]
        heads = [s[:-1] if t else s for s, t in zip(text, tails, strict=True)]
        letters = [i for i, ok in enumerate(map(str.isalpha, heads)) if ok] if self.ends is not None else []
        rest = set(range(len(runs))).difference(letters)
        for at in range(0, len(letters), 4096):
            part = letters[at:at + 4096]
            ids = np.array(self._ids([" ".join([heads[i] for i in part])])[0], np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):  # a word that the rules split further
                rest.update(part)
                continue
            raw, stops = ids.tobytes(), (4 * cuts).tolist()
            self.ids.update((runs[i], raw[lo:hi] + self.marks[tails[i]])
                            for i, lo, hi in zip(part, [0, *stops[:-1]], stops, strict=True))
        others = sorted(rest)
        for at in range(0, len(others), 4096):
            part = others[at:at + 4096]
            got = self._ids([text[i] for i in part])
            self.ids.update((runs[i], np.array(x, np.uint32).tobytes()) for i, x in zip(part, got, strict=True))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _dtype(vocab: int):
    return np.uint16 if vocab <= 1 << 16 else np.uint32


def _encode(path: str, end_id: int, bounds: list[float], dtype):
    """(doc_id, text) to (part, doc_id, ids)."""
    end = np.array([end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids = [x.astype(dtype, copy=False).tobytes() + end for x in encoder.encode(b.column(1).to_pylist())]
                key = b.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
                part = np.where(np.isnan(key), 0, np.searchsorted(bounds, key, side="right"))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), b.column(0), pa.array(ids, pa.binary())],
                                                 names=["part", "doc_id", "ids"])
    return run


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_schema(seq: int, dtype=np.uint16) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq)), ("mask", pa.list_(pa.bool_(), seq))])


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _name(path: str, part: int, file: int, kind: str) -> str:
    return f"{path}/{kind}-{part:06d}-{file:08d}.arrow"


class _Writer:
    """The files of one range, written as its documents arrive."""

    def __init__(self, folder: str, part: int, seq: int, seqs: int, batch: int, dtype):
        self.fs, self.path = _open(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.part, self.seq, self.dtype = part, seq, dtype
        self.per_batch, self.per_file = seq * batch, seq * seqs
        self.schema = file_schema(seq, dtype)
        self.n_ids = self.n_docs = self.n_files = self.held = 0
        self.parts: list[np.ndarray] = []
        self.index: list[tuple[int | None, int, int]] = []
        self.out = self.own = None

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.index.append((doc, self.n_ids, len(ids)))
        self.n_docs += 1
        while len(ids):
            take = min(len(ids), self.per_batch - self.held)
            self.parts.append(ids[:take])
            self.held, self.n_ids, ids = self.held + take, self.n_ids + take, ids[take:]
            if self.held == self.per_batch:
                self.flush()
                if self.n_ids % self.per_file == 0:
                    self.close()

    def flush(self) -> None:
        if not self.held:
            return
        if self.out is None:
            self.own = uuid.uuid4().hex
            self.sink = self.fs.open_output_stream(f"{_name(self.path, self.part, self.n_files, 'ids')}.{self.own}.part")
            self.out = pa.ipc.new_file(self.sink, self.schema)
        n = -(-self.held // self.seq) * self.seq
        ids, mask = np.zeros(n, self.dtype), np.arange(n) < self.held
        ids[:self.held] = np.concatenate(self.parts)
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq) for x in (ids, mask)], schema=self.schema))
        self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        if self.out is None:
            return
        self.out.close()
        self.sink.close()
        name = _name(self.path, self.part, self.n_files, "ids")
        self.fs.move(f"{name}.{self.own}.part", name)
        here = [x for x in self.index if x[1] // self.per_file == self.n_files]
        self.index = [x for x in self.index if x[1] // self.per_file > self.n_files]
        name = _name(self.path, self.part, self.n_files, "docs")
        columns = zip(*here, strict=True) if here else ((), (), ())
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, INDEX, strict=True)], schema=INDEX)
        with self.fs.open_output_stream(f"{name}.{self.own}.part") as f, pa.ipc.new_file(f, INDEX) as w:
            w.write_table(table)
        self.fs.move(f"{name}.{self.own}.part", name)
        self.out, self.n_files = None, self.n_files + 1


_WRITTEN = pa.schema([("part", pa.int32()), ("file", pa.int64()), ("n_ids", pa.int64())])


def _write(folder: str, seq: int, seqs: int, batch: int, dtype):
    """(part, doc_id, ids) in order to (part, file, n_ids of the part) per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None

        def done() -> pa.RecordBatch:
            writer.close()
            n = writer.n_files
            return pa.RecordBatch.from_arrays([pa.array([writer.part] * n, pa.int32()), pa.array(range(n), pa.int64()),
                                               pa.array([writer.n_ids] * n, pa.int64())], schema=_WRITTEN)

        for b in batches:
            for part, doc, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None or writer.part != part:
                    if writer is not None:
                        yield done()
                    writer = _Writer(folder, part, seq, seqs, batch, dtype)
                writer.add(doc, np.frombuffer(ids, dtype))
        if writer is not None:
            yield done()
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", seq: int = SEQ, seqs: int = SEQS, batch: int = BATCH) -> DataFrame:
    """Encode ``docs`` and write the files to ``folder`` (shared storage); one row (part, file, base) per file.

    ``base``: ids of all ranges before the file's range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(F.col("doc_id").cast("double").alias("d")).approxQuantile(
        "d", [i / n for i in range(1, n)], 1 / (4 * n))
    bounds = sorted(set(found))
    dtype = _dtype(max(_encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1))
    coded = rows.mapInArrow(_encode(tokenizer_path, end_id, bounds, dtype), "part int, doc_id long, ids binary")
    ordered = coded.repartition(n, "part").sortWithinPartitions("part", "doc_id", "ids")
    written = store(ordered.mapInArrow(_write(folder, seq, seqs, batch, dtype), "part int, file long, n_ids long"),
                    "tokens-files")
    # one row per range; there are as many as partitions
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = written.where("file = 0").select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return written.join(sums, "part").select("part", "file", "base")


class Reader:
    """Random access to the ids of one range of a folder; batches are used in place."""

    def __init__(self, folder: str, part: int, seq: int = SEQ, seqs: int = SEQS, batch: int = BATCH):
        self.fs, self.path = _open(folder)
        self.part, self.seq, self.per_file, self.per_batch = part, seq, seq * seqs, seq * batch
        self.file, self.reader, self.source = -1, None, None

    def _at(self, file: int) -> pa.ipc.RecordBatchFileReader:
        if file != self.file:
            if self.source is not None:
                self.source.close()
            name = _name(self.path, self.part, file, "ids")
            local = isinstance(self.fs, pafs.LocalFileSystem)
            self.source = pa.memory_map(name) if local else self.fs.open_input_file(name)
            self.file, self.reader = file, pa.ipc.open_file(self.source)
        return self.reader

    def spans(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids start to start + n of the range, in arrays of one batch at most."""
        while n:
            file, offset = divmod(start, self.per_file)
            b, inside = divmod(offset, self.per_batch)
            batch = self._at(file).get_batch(b)
            ids = batch.column(0).values.to_numpy()[inside:inside + n]
            mask = batch.column(1).values.slice(inside, len(ids))
            if not len(ids) or mask.true_count != len(ids):
                raise ValueError(f"file {file} of range {self.part} has padding where ids are due")
            yield ids
            start, n = start + len(ids), n - len(ids)

    def sequence(self, s: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file) and mask of the range's sequence s."""
        file, offset = divmod(s * self.seq, self.per_file)
        b, inside = divmod(offset, self.per_batch)
        batch = self._at(file).get_batch(b)
        cut = slice(inside, inside + self.seq)
        return batch.column(0).values.to_numpy()[cut], batch.column(1).values[cut]

    def index(self, file: int) -> pa.Table:
        with self.fs.open_input_file(_name(self.path, self.part, file, "docs")) as f:
            return pa.ipc.open_file(f).read_all()


def _read(folder: str, seq: int, seqs: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for part, file, base in zip(*(c.to_pylist() for c in files.columns), strict=True):
                reader = Reader(folder, part, seq, seqs, batch)
                index = reader.index(file)
                sums = []
                for start, n in zip(index["start"].to_pylist(), index["n_tokens"].to_pylist(), strict=True):
                    crc = 0
                    for ids in reader.spans(start, n):
                        crc = zlib.crc32(ids.astype("<u4"), crc)
                    sums.append(crc)
                start = pa.array(index["start"].to_numpy() + base, pa.int64())
                out = pa.table([index["doc_id"], start, index["n_tokens"], pa.array(sums, pa.int64())],
                               names=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield from out.combine_chunks().to_batches()
    return run


def read_checksums(files: DataFrame, folder: str, seq: int = SEQ, seqs: int = SEQS, batch: int = BATCH) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of all ids (as 32-bit integers), read back file by file."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("part", "file", "base").repartition(n, "part", "file").mapInArrow(
        _read(folder, seq, seqs, batch), "doc_id long, start long, n_tokens long, ids_crc32 long")


__all__ = ["ChunkEncoder", "Reader", "file_schema", "read_checksums", "write_tokens"]
