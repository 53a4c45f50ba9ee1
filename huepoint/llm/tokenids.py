"""Token ids in flat binary files.

Documents are dealt to shards by ranges of their id, in ascending order (null last; rows that repeat an
id in the order of their texts). A shard is two files: ``.ids``, the ids of its documents one after
another as little-endian unsigned integers (16 bits if the vocabulary allows, else 32), and ``.off``,
for each document its id and the 64-bit offset of its first token in the shard, with the end as last
offset. The base of a shard is the prefix sum of the shards before it; ``index.json`` lists them. A
shard is written under a name of its own attempt, so a rerun or a second attempt never mixes with it.

Null and empty texts give the end id alone. An empty table gives no shards. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huepoint.llm._exchange import Layout
from huepoint.llm._store import local_rows, shared_folder
from huepoint.llm._words import MEMOS, forget, give_back

NULL_ID = np.iinfo(np.int64).max
MEMO_WORDS = 400_000
SHARD = "part int, path string, docs long, tokens long"


#: What a vocabulary file must say for its texts to be the sum of their words.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Letters up to U+012F, which neither compose with each other nor change length in lower case, then marks but no apostrophe.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([!-&(-/:-@\\[-`{-~]*)")


#: Ids of pieces by vocabulary, kept from task to task of a worker.
_PIECES: dict[tuple[str, str], dict[str, bytes]] = {}
MEMOS.append(_PIECES)


class Encoder:
    """encode(texts) with a memory for the blank-separated words.

    Where the vocabulary's rules never look across white space (it is folded, split off and dropped), the
    ids of a text are those of its words, one after another, and those of a word of plain letters with
    marks after it are the model's for the letters and for the marks. Other vocabularies, and ``exact``,
    encode the text as a whole.
    """

    def __init__(self, path: str, end_id: int, dtype: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.dtype, self.known, self.pieces = Tokenizer.from_file(path), dtype, {}, _PIECES.setdefault((path, dtype), {})
        self.kind = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.end = np.array([end_id], dtype).tobytes()
        # of the rules alone: the whole file, read as JSON, takes tens of MB in each task
        rule = lambda x: json.loads(x.__getstate__()) if x else {}
        split = rule(self.tokenizer.pre_tokenizer).get("pretokenizers", [{}, {}])
        self.by_word = (
            rule(self.tokenizer.normalizer).get("normalizers") == NORMAL
            and not self.tokenizer.post_processor
            and (split[0].get("pattern"), split[0].get("behavior"), split[0].get("invert")) == ({"Regex": SPLIT}, "Removed", True)
            and [x.get("type") for x in split] == ["Split", "ByteLevel"]
            and not any(t.lstrip or t.rstrip or t.single_word or t.normalized or any(c.isspace() for c in t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        )
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(33, 0x130)}

    def exact(self, text: str) -> bytes:
        return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids) + self.end

    def _ids(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def _piece(self, x: str) -> bytes:
        """Of letters or of marks alone, in lower case."""
        if (got := self.pieces.get(x)) is None:
            if len(self.pieces) >= MEMO_WORDS:
                self.pieces.clear()
            got = self.pieces[x] = self._ids([t.id for t in self.tokenizer.model.tokenize(x if x.isascii() else x.translate(self.letters))])
        return got

    def _learn(self, words: list[bytes]) -> None:
        odd = []
        for w in words:
            if m := PLAIN.fullmatch(x := w.decode()):
                self.known[w] = self._piece(m[1].lower()) + (self._piece(m[2]) if m[2] else b"")
            else:
                odd.append((w, x))
        for at in range(0, len(odd), 1000):
            part = odd[at : at + 1000]
            for (w, _), e in zip(part, self.tokenizer.encode_batch_fast([x for _, x in part], add_special_tokens=False)):
                self.known[w] = self._ids(e.ids)

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        if not self.by_word:
            yield from (self.exact(t.decode() if t else "") for t in texts)
            return
        words = [t.split() if t else [] for t in texts]
        new = set().union(*words).difference(self.known) if words else set()
        if len(self.known) + len(new) > MEMO_WORDS:
            self.known = {}
            new = set().union(*words)
        self._learn(sorted(new))
        for w in words:
            yield b"".join(map(self.known.__getitem__, w)) + self.end


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri.removeprefix("file:"))


def write(docs: DataFrame, path: str, folder: str, end_id: int = 1) -> list[dict]:
    """Writes the shards and ``index.json``; returns the index: part, path, docs, tokens, base, dtype in order."""
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    layout = Layout(docs)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(but=_PIECES)
        encoder, at = Encoder(path, end_id, dtype), 0
        fs, base = _filesystem(folder)
        fs.create_dir(base)
        part = TaskContext.get().partitionId()
        name = f"shard-{part:06d}-{uuid.uuid4().hex}"
        ids, offsets, item = [], [], np.dtype(dtype).itemsize
        with fs.open_output_stream(f"{base}/{name}.ids") as out:
            for b in batches:
                texts = b["text"].to_pylist()
                for lo in range(0, len(texts), 200):
                    for tokens in encoder.encode(texts[lo : lo + 200]):
                        out.write(tokens)
                        offsets.append(at)
                        at += len(tokens) // item
                ids += [NULL_ID if i is None else i for i in b["doc_id"].to_pylist()]
                give_back()
        with fs.open_output_stream(f"{base}/{name}.off") as out:
            out.write(np.array(ids + offsets + [at], "<i8").tobytes())
        if ids:
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "path": pa.array([f"{folder}/{name}"]), "docs": pa.array([len(ids)], pa.int64()), "tokens": pa.array([at], pa.int64())})

    dealt = docs.select("doc_id", F.col("text").cast("binary").alias("text")).repartitionByRange(layout.partitions, F.col("doc_id").asc_nulls_last())
    found = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text").mapInArrow(fn, SHARD).collect()  # a row for each shard
    index, base = [], 0
    for r in sorted(found, key=lambda r: r["part"]):
        index.append(r.asDict() | {"base": base, "dtype": dtype})
        base += r["tokens"]
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/index.json")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(json.dumps(index).encode()))
    out.close()
    return index


def open_shard(path: str, docs: int, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of its documents, offsets, and all token ids, memory-mapped where the file is a local one."""
    fs, base = _filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem):
        head, tokens = np.memmap(f"{base}.off", "<i8", "r"), np.memmap(f"{base}.ids", dtype, "r")
    else:
        read = lambda end, kind: np.frombuffer(fs.open_input_stream(base + end).read(), kind)
        head, tokens = read(".off", "<i8"), read(".ids", dtype)
    return head[:docs], head[docs:], tokens


def read(spark: SparkSession, index: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers), from the files."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, off, tokens = open_shard(r["path"], r["docs"], r["dtype"])
                for lo in range(0, len(ids), 10_000):
                    at = off[lo : lo + 10_001]
                    crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                    some = ids[lo : lo + 10_000]
                    yield pa.record_batch({"doc_id": pa.array(some, pa.int64(), mask=np.asarray(some == NULL_ID)), "start": pa.array(at[:-1] + r["base"]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    kinds = {"path": pa.string(), "docs": pa.int64(), "base": pa.int64(), "dtype": pa.string()}
    shards = local_rows(spark, {c: pa.array([r[c] for r in index], kind) for c, kind in kinds.items()})
    return (shards.repartition(len(index)) if index else shards).mapInArrow(fn, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    return read(docs.sparkSession, write(docs, path, shared_folder(docs.sparkSession) + "/tokens", end_id))
