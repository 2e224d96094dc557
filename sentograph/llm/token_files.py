"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, read by memory mapping.

A data set is a folder of parts in ascending order of the key. Part p has

* ``ids-p.bin``: the ids of its documents one after another, unsigned 16 bits each where the vocabulary fits, else 32;
* ``offsets-p.bin``: for each document and the end, the count of ids before it in the whole data set, unsigned 64 bits;
* ``keys-p.bin``: the documents' keys, signed 64 bits, the least of all for a null key;

all little-endian. Tasks write ids and lengths, the driver sums the parts' totals (one number a part) into bases, and
tasks write the offsets from base and lengths. Files are written under a name of their own and renamed, so a task may
run again at any time.

With a tokenizer that splits at white space and drops it, the encoding of a text is that of its words, put together, and
each distinct word of a batch is encoded once, or taken from those that the process has encoded before. The tokenizer's own settings tell; with any other whole texts are encoded.

Defined results: a null or empty text has just the end id; repeated keys follow one another in order of their text;
null keys come first; an empty table makes a data set of no parts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import open_fs, publish

NULL_KEY = -(2**63)
#: Letters that lower-case and normalise to one letter each; words of only these are one token group each.
PLAIN = r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+"
#: Bytes of text that are encoded at once.
SLICE = 32_000_000
#: Words (some 30 bytes each with their ids) that an encoder keeps from batch to batch; those that come after are encoded in each batch.
MOST_KNOWN = 600_000


def splits_at_space(spec: dict) -> bool:
    """Whether a tokenizer's file makes groups that end at white space, drops that, and marks a group's last token, so that words can be encoded one by one."""
    normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [(x.get("type"), x.get("pattern"), x.get("content")) for x in normal.get("normalizers", [])]
    split = (before.get("pretokenizers") or [{}])[0]
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [x.get("type") for x in before.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        and split.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and split.get("behavior") == "Removed" and split.get("invert") is True
        and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
        and spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("dropout")
    )


_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file: each distinct word once where its settings allow that, else whole texts."""

    def __init__(self, path: str):
        import json

        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = splits_at_space(json.load(f))
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(names.values()) + 1
        self.vocabulary = size
        self.ends = np.zeros(size, bool)
        for token, k in names.items():
            self.ends[k] = token.endswith("</w>")
        #: Words that were encoded before, their ids one after another, and the count of each.
        self.cache = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The encoder of this process, which goes on knowing words from task to task."""
        if path not in _encoders:
            _encoders.clear()
            _encoders[path] = cls(path)
        return _encoders[path]

    def forms(self, own: pa.Array):
        """(ids of distinct words one after another, count for each word)."""
        import numpy as np
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(own, f"^{PLAIN}$")
        simple, rest = own.filter(plain), own.filter(pc.invert(plain)).to_pylist()
        plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        parts, counts = [], []
        bounds = np.append(np.arange(0, len(simple), 200), len(simple))
        lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), simple)
        for k, line in enumerate(pc.binary_join(lists, pa.scalar(" ", simple.type)).to_pylist() if len(simple) else []):
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != bounds[k + 1] - bounds[k]:
                raise AssertionError("a plain word is more than one group")
            parts.append(ids)
            counts.append(np.diff(last, prepend=-1))
        for k in range(0, len(rest), 5000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(rest[k : k + 5000], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            parts.append(np.fromiter(chain.from_iterable(found), np.int32, int(counts[-1].sum())))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(own), np.int64)
        order, sizes = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), np.concatenate(counts)
        lengths, begins = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        lengths[order], begins[order] = sizes, np.cumsum(sizes) - sizes
        return gather(np.concatenate(parts), begins, lengths, np.arange(len(own))), lengths

    def distinct(self, words: pa.Array):
        """(ids of all words one after another, count for each word)."""
        import numpy as np
        import pyarrow.compute as pc

        # A full stop or comma after a letter or digit is a group of its own.
        point = pc.match_substring_regex(words, "[0-9A-Za-z][.,]$")
        coded = pc.if_else(point, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        which, own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        known, known_flat, known_lengths = self.cache
        at = pc.fill_null(pc.index_in(own, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = own.filter(pa.array(at < 0))
        new_flat, new_lengths = self.forms(new)
        at[at < 0] = len(known) + np.arange(len(new))
        marks = [np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, np.int32) for m in ".,"]
        flat = np.concatenate([known_flat, new_flat, *marks])
        lengths = np.concatenate([known_lengths, new_lengths, [len(m) for m in marks]])
        begins = np.cumsum(lengths) - lengths
        if room := min(MOST_KNOWN - len(known), len(new)):
            self.cache = pa.concat_arrays([known, new.slice(0, room)]), np.append(known_flat, new_flat[: int(new_lengths[:room].sum())]), np.append(known_lengths, new_lengths[:room])
        # A word is its bare form, then perhaps a mark.
        cut = point.to_numpy(zero_copy_only=False).astype(bool)
        two = np.empty((len(words), 2), np.int64)
        two[:, 0] = at[which]
        two[:, 1] = np.where(cut, len(lengths) - 2 + pc.ends_with(words, ",").to_numpy(zero_copy_only=False).astype(np.int64), -1)
        return gather(flat, begins, lengths, two[two >= 0]), lengths[two[:, 0]] + np.where(cut, lengths[two[:, 1]], 0)

    def encode(self, texts: pa.Array, end: int | None = None):
        """(ids of all texts one after another, count for each text); end: an id after each text."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            return self._whole(texts.to_pylist(), end)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        index = coded.indices.to_numpy(zero_copy_only=False)[: bounds[-1] - bounds[0]]
        bounds = bounds - bounds[0]
        flat, lengths = self.distinct(coded.dictionary)
        begins = np.cumsum(lengths) - lengths
        if end is not None:  # as a word of its own
            flat, begins, lengths = np.append(flat, np.int32(end)), np.append(begins, len(flat)), np.append(lengths, 1)
            index = np.insert(index, bounds[1:], len(lengths) - 1)
            bounds = bounds + np.arange(len(bounds))
        sums = np.append(0, np.cumsum(lengths[index]))
        return gather(flat, begins, lengths, index), sums[bounds[1:]] - sums[bounds[:-1]]

    def _whole(self, texts: list[str], end: int | None):
        import numpy as np

        more = [] if end is None else [end]
        ids = [np.array([*x.ids, *more], np.int32) for k in range(0, len(texts), 100) for x in self.tokenizer.encode_batch_fast(texts[k : k + 100], add_special_tokens=False)]
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.fromiter(map(len, ids), np.int64, len(ids))


def gather(flat, begins, lengths, index, most: int = 1 << 19):
    """The runs ``flat[begins[i] : begins[i] + lengths[i]]`` for each i of index, one after another. Places are made for ``most`` runs at once."""
    import numpy as np

    n = lengths[index]
    out, at = np.empty(int(n.sum()), flat.dtype), 0
    for k in range(0, len(index), most):
        own = n[k : k + most]
        ends = np.cumsum(own)
        total = int(ends[-1])
        out[at : at + total] = flat[np.repeat(begins[index[k : k + most]] - (ends - own), own) + np.arange(total)]
        at += total
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most about so many bytes in the column, a row at least."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def merged(batches: Iterator[pa.RecordBatch], most: int = SLICE // 2) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about that many bytes, where those that come are smaller: a larger batch repeats more words."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end: int = 2, key: str = "doc_id", text: str = "text") -> list[dict]:
    """Writes the data set; returns its parts (part, documents, tokens, base, dtype), a dict each, in order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoder, part = WordEncoder.of(tokenizer), TaskContext.get().partitionId()
        kind = "<u2" if max(encoder.vocabulary - 1, end) < 2**16 else "<u4"
        keys, counts = [], []

        def ids():
            for whole in merged(batches):
                for batch in slices(whole, "text"):
                    flat, lengths = encoder.encode(batch.column("text"), end)
                    keys.append(batch.column("key").fill_null(NULL_KEY).to_numpy(zero_copy_only=False).astype("<i8"))
                    counts.append(lengths.astype("<i8"))
                    yield flat.astype(kind).tobytes()

        stream = ids()
        first = next(stream, None)
        if first is None:
            return

        def chunks():
            yield first
            yield from stream

        publish(f"{folder}/ids-{part:06d}.bin", chunks())
        publish(f"{folder}/keys-{part:06d}.bin", [np.concatenate(keys).tobytes()])
        publish(f"{folder}/lengths-{part:06d}.bin", [np.concatenate(counts).tobytes()])
        n = sum(map(len, keys))
        yield pa.RecordBatch.from_pydict({"part": [part], "documents": [n], "tokens": [int(sum(x.sum() for x in counts))], "dtype": [kind]})

    ordered = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange(F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")
    parts = sorted((r.asDict() for r in ordered.mapInArrow(encode, "part long, documents long, tokens long, dtype string").collect()), key=lambda r: r["part"])
    base = 0
    for p in parts:
        p["base"] = base
        base += p["tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for p in batch.to_pylist():
                lengths = np.frombuffer(content(f"{folder}/lengths-{p['part']:06d}.bin"), "<i8")
                offsets = np.append(0, np.cumsum(lengths)).astype("<u8") + np.uint64(p["base"])
                publish(f"{folder}/offsets-{p['part']:06d}.bin", [offsets.astype("<u8").tobytes()])
            yield pa.RecordBatch.from_pydict({"part": batch.column("part")})

    part_rows(documents.sparkSession, parts).mapInArrow(place, "part long").collect()
    return parts


PARTS = "part long, documents long, tokens long, dtype string, base long"


def part_rows(spark: SparkSession, parts: list[dict]) -> DataFrame:
    """A row for each part, spread over tasks."""
    rows = spark.createDataFrame([(p["part"], p["documents"], p["tokens"], p["dtype"], p["base"]) for p in parts], PARTS)
    return rows.repartition(max(1, len(parts)))


def content(uri: str):
    """A file's bytes: mapped into memory where the file system allows it, read otherwise."""
    from pyarrow import fs

    files, path = open_fs(uri)
    if isinstance(files, fs.LocalFileSystem):
        with pa.memory_map(path) as mapped:
            return mapped.read_buffer()
    with files.open_input_file(path) as stream:
        return stream.read_buffer()


def read_tokens(spark: SparkSession, folder: str, parts: list[dict], columns: dict[str, str], derive) -> DataFrame:
    """A row for each document, from the files: key, start, n_tokens, and what ``derive(ids)`` returns for its columns.

    derive gets a document's ids as an array over the mapped file; columns: name and SQL type of what it returns, as a tuple.
    """
    schema = "key long, start long, n_tokens long" + "".join(f", {n} {t}" for n, t in columns.items())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for p in batch.to_pylist():
                name = f"{p['part']:06d}.bin"
                keys = np.frombuffer(content(f"{folder}/keys-{name}"), "<i8")
                offsets = np.frombuffer(content(f"{folder}/offsets-{name}"), "<u8").astype(np.int64)
                ids = np.frombuffer(content(f"{folder}/ids-{name}"), p["dtype"])
                local = (offsets - offsets[0]).tolist()
                for at in range(0, len(keys), 20_000):
                    to = min(at + 20_000, len(keys))
                    more = [derive(ids[a:b]) for a, b in zip(local[at:to], local[at + 1 : to + 1])]
                    own = keys[at:to]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_KEY), pa.array(offsets[at:to]), pa.array(np.diff(offsets[at : to + 1]))] + [pa.array([m[k] for m in more]) for k in range(len(columns))],
                        names=["key", "start", "n_tokens", *columns])

    return part_rows(spark, parts).mapInArrow(read, schema)


def checksum(ids) -> tuple[int]:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    return (zlib.crc32(ids.astype("<u4").tobytes()),)
