"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive turn prefixes are rendered and
consecutive outputs compared: what the longer one adds is the span of its last turn, and where it does not begin with
the shorter one the template has rewritten history. Where the text lies in a span shows by rendering once more with
another text in its place: what stays at both ends is the template's. The output is kept as files: the
formatted text, and for each turn the byte places of its span and text, how the text is written there, and whether it is under
the loss mask. What can't be read back from a span (a role that it doesn't tell, a text that the template changes) lies aside in a
file of its own, so reading needs to know nothing of a template.

Turns are sorted by range of (conversation, turn), so a conversation of any size is spread over tasks, and kept as files by
range. A task then renders the turns of one range; where its first conversation began in ranges before, it reads that one's earlier turns
from their files, so every turn is rendered after its whole history, however the rows are spread. As the template is a black
box, that takes memory in proportion to a conversation, and time to the square of its turns; ``most`` bounds both, for templates
that look back no farther than so many turns, which is all that is then rendered and compared. Reading streams a
conversation's portions in order; its digests are sequential, and no more than a turn is held at a time.

Defined results: a null text or role is empty; turns of equal number follow in order of role and text; null turns
come first; a null conversation id is a conversation; repeated rows are turns of their own; an empty table gives an
empty result. A turn that rewrites history is kept as what has to be cut off from the text before it and what follows then, so
the portions give the rendering of the whole; its conversation is marked, and nothing of it is learnt, as earlier spans no longer hold.
"""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Draft, open_fs, publish, stored

#: Turns whose spans are gathered before they are written; the output doesn't depend on it.
WINDOW = 16
LEARN = "assistant"
#: Strings that mark turns in the default template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ASSISTANT]", "[ROLE ", "[/ROLE]")
_STARTS = re.compile(r"\\|(?=" + "|".join(map(re.escape, CONTROL)) + r")[\s\S]")

Turn = tuple[str, str]


def escape(text: str) -> str:
    """The text with a backslash after the first character of each control string, and before each backslash."""
    return _STARTS.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text) if "\\" in text else text


#: Turns with texts up to this length are not formatted anew for each prefix.
SHORT = 2048


def whole_line(role: str, text: str) -> str:
    body = escape(text)
    if role == "user":
        return f"<s>[INST] {body} [/INST]\n"
    if role == LEARN:
        return f"[ASSISTANT] {body} </s>\n"
    return f"<s>[ROLE {escape(role).replace(']', chr(92) + ']')}] {body} [/ROLE]\n"


_lines: dict[Turn, str] = {}


def short_line(role: str, text: str) -> str:
    line = _lines.get((role, text))
    if line is None:
        if len(_lines) >= 4096:
            _lines.clear()
        line = _lines[role, text] = whole_line(role, text)
    return line


def render(turns: list[Turn]) -> str:
    """The default template."""
    return "".join([(short_line if len(text) <= SHORT else whole_line)(role, text) for role, text in turns])


def role_of(head: str) -> str | None:
    """The role that the default template's text before a turn's text tells of; None if it isn't that template's."""
    if head == "<s>[INST] ":
        return "user"
    if head == "[ASSISTANT] ":
        return LEARN
    return unescape(head[len("<s>[ROLE ") : -len("] ")]) if head.startswith("<s>[ROLE ") and head.endswith("] ") else None


class Rewritten(Exception):
    """The template changed what it had made of earlier turns; ``turn`` is the one that made it do so."""

    def __init__(self, turn: int):
        super().__init__(f"turn {turn} changes the rendering of turns before it")
        self.turn = turn


def same_start(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def steps(turns: Iterator[Turn], template: Callable[[list[Turn]], str] = render, history: list[Turn] | None = None, most: int | None = None) -> Iterator[tuple[str, int, int, str]]:
    """(span, start of the text in it, end, what is cut off before it) of each turn after the history; start and end are -1 where it rewrites.

    most: turns of history that are rendered, up to twice as many; all if None.
    """
    before = list(history or [])
    known = template([*before]) if before else ""
    for role, text in turns:
        if most is not None and len(before) >= 2 * most:
            del before[:-most]
            known = template([*before])
        now = template([*before, (role, text)])
        if now.startswith(known):
            span = now[len(known) :]
            # Two other texts, which differ in first and last character, show the template's own ends.
            a, b = (template([*before, (role, x)])[len(known) :] for x in ("0", "1"))
            head, tail = same_start(a, b), same_start(a[::-1], b[::-1])
            head = min(head, len(span))
            yield span, head, max(head, len(span) - tail), ""
        else:
            same = same_start(known, now)
            yield now[same:], -1, -1, known[same:]
        before.append((role, text))
        known = now


def spans(turns: list[Turn], template: Callable[[list[Turn]], str] = render, history: list[Turn] | None = None) -> list[tuple[str, int, int]]:
    """(span, start of the text in it, end) of each turn after the history. Raises Rewritten."""
    out = []
    for nth, (span, start, end, _) in enumerate(steps(iter(turns), template, history)):
        if start < 0:
            raise Rewritten(nth)
        out.append((span, start, end))
    return out


def _rows(folder: str, part: int, skip: int = 0) -> Iterator[tuple[int | None, str, str]]:
    """(conv_id, role, text) of a range's turns, from the given one on."""
    files, path = open_fs(f"{folder}/rows-{part:06d}.arrow")
    with files.open_input_stream(path, compression=None) as source:
        for batch in pa.ipc.open_stream(source):
            yield from zip(*[c.to_pylist() for c in batch.slice(min(skip, batch.num_rows)).columns])
            skip = max(0, skip - batch.num_rows)


def _ranges(sorted_rows: DataFrame, folder: str) -> DataFrame:
    """Keeps the rows as a file a task; returns (part, history, skip) of each: the parts that hold earlier turns of its first
    conversation, and how many rows of the first of these to leave out."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyspark import TaskContext

        part, rows, ends, last_from = TaskContext.get().partitionId(), 0, [], 0
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return

        def chunks():
            nonlocal rows, last_from
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, first.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                for batch in (b for some in ((first,), batches) for b in some):
                    out.write_batch(batch)
                    for n, conv in enumerate(batch.column(0).to_pylist(), rows):
                        if not ends:
                            ends[:] = [conv, conv]
                        elif conv != ends[1]:
                            ends[1], last_from = conv, n
                    rows += batch.num_rows
                    yield sink.getvalue()
                    sink.seek(0)
                    sink.truncate()
            yield sink.getvalue()

        publish(f"{folder}/rows-{part:06d}.arrow", chunks())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, *ends, last_from)], names=["part", "first", "last", "last_from"])

    found = sorted(tuple(r) for r in sorted_rows.mapInArrow(keep, "part long, first long, last long, last_from long").collect())
    out: list[tuple[int, list[int], int]] = []
    for k, (part, first, _, _) in enumerate(found):
        history, skip = [], 0
        if k and found[k - 1][2] == first:
            before, _, _, skip = found[k - 1][0], *found[k - 1][1:]
            history = [before]
            if skip == 0 and out[-1][1]:  # nothing else is in that part
                history, skip = [*out[-1][1], before], out[-1][2]
        out.append((part, history, skip))
    return sorted_rows.sparkSession.createDataFrame(out, "part long, history array<long>, skip long").repartitionByRange(max(1, len(out)), "part")


def format_conversations(rows: DataFrame, folder: str, template: Callable[[list[Turn]], str] = render, window: int = WINDOW, key: str = "conv_id", most: int | None = None) -> DataFrame:
    """Writes the output; returns its portions (part, nth, conv_id, first_turn, turns, at, rewrites) as a stored table.

    most: of ``steps``; by default each turn is rendered after its whole history."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    empty = F.lit("")
    clean = rows.select(F.col(key).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    # By the start of the text, not a hash of it, so that turns of equal number are in order over ranges too.
    sorted_rows = clean.repartitionByRange(*order[:3], F.substring("text", 1, 256)).sortWithinPartitions(*order).select("conv_id", "role", "text")
    parts = _ranges(sorted_rows, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        for row in (r for batch in batches for r in batch.to_pylist()):
            part, portions, marks, size = row["part"], [], [], 0  # a portion: nth, conv_id, first turn (number of the span record), turns, byte offset, rewrites
            aside, roles = Draft(f"{folder}/aside-{part:06d}.bin"), {}

            def kept(role: str) -> tuple[int, int]:
                """Where a role lies aside; those that come again lie there once, or nearly."""
                if role not in roles:
                    if len(roles) >= 1024:
                        roles.clear()
                    data = role.encode()
                    roles[role] = (aside.write(data), len(data))
                return roles[role]

            def chunks():
                nonlocal size
                past = deque(maxlen=None if most is None else 2 * most)
                past.extend((role, text) for n, p in enumerate(row["history"]) for _, role, text in _rows(folder, p, 0 if n else row["skip"]))
                for conv, own in groupby(_rows(folder, part), key=lambda x: x[0]):
                    p = [len(portions), conv, len(marks), 0, size, False]
                    portions.append(p)
                    turns = []  # noted as they are rendered

                    def noted():
                        for _, role, text in own:
                            turns.append((role, text))
                            yield role, text

                    found = steps(noted(), template, past, most)
                    past = []
                    while some := list(islice(found, window)):
                        for (role, text), (span, a, b, cut) in zip(turns, some):
                            data, told = span.encode(), a >= 0 and role_of(span[:a]) == role
                            head, end = (len(span[:a].encode()), len(span[:b].encode())) if a >= 0 else (-1, -1)
                            role_at, role_size = (IN_SPAN, 0) if told else kept(role)
                            if a >= 0 and span[a:b] == text:
                                text_at, text_size = IN_SPAN, 0
                            elif a >= 0 and span[a:b] == escape(text):
                                text_at, text_size = ESCAPED, 0
                            else:
                                other = text.encode()
                                text_at, text_size = aside.write(other), len(other)
                            marks.append(struct.pack(MARK, len(data), head, end, int(a >= 0 and role == LEARN), len(cut.encode()), len(cut), role_at, role_size, text_at, text_size))
                            p[3] += 1
                            p[5] |= a < 0
                            size += len(data)
                            yield data
                        turns.clear()

            publish(f"{folder}/text-{part:06d}.txt", chunks())
            publish(f"{folder}/turns-{part:06d}.bin", [b"".join(marks)])
            aside.close()
            columns = list(zip(*portions))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(portions), pa.int64())] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["part", "nth", "conv_id", "first_turn", "turns", "at", "rewrites"])

    out = stored(parts.mapInArrow(write, "part long, nth long, conv_id long, first_turn long, turns long, at long, rewrites boolean"), "portions")
    for r in parts.select("part").collect():
        files, path = open_fs(f"{folder}/rows-{r['part']:06d}.arrow")
        files.delete_file(path)
    return out


#: Bytes that are read at once.
READ = 4 << 20
#: Of a turn: bytes of its span, start and end of the text in it (-1 if it rewrites), whether it is learnt, bytes and code points cut off
#: before it, place and bytes of its role aside, place and bytes of its text aside.
MARK = "<qqqqqqqqqq"
#: For a place: the span itself tells it, as it is or escaped.
IN_SPAN, ESCAPED = -1, -2


def read_turns(folder: str, part: int, first: int, turns: int, at: int, opened: dict) -> Iterator[tuple[str, str, bool, int]]:
    """(role, text, learnt, code points that it adds) of a portion's turns, read piece by piece."""
    if opened.get("part") != part:
        for f in opened.get("files", ()):
            f.close()
        names = [f"{folder}/{kind}-{part:06d}.{end}" for kind, end in (("text", "txt"), ("turns", "bin"), ("aside", "bin"))]
        opened.update(part=part, files=[files.open_input_file(path) for files, path in map(open_fs, names)], roles={})
    text, marks, aside = opened["files"]
    roles = opened["roles"]

    def lying(place: int, size: int) -> str:
        aside.seek(place)
        return aside.read(size).decode()

    done = 0
    while done < turns:
        marks.seek((first + done) * struct.calcsize(MARK))
        some = list(struct.iter_unpack(MARK, marks.read(struct.calcsize(MARK) * min(turns - done, 1024))))
        text.seek(at)
        held, place = text.read(min(sum(x[0] for x in some), READ)), 0
        for whole, head, end, learnt, _, lost, role_at, role_size, text_at, text_size in some:
            if place + whole > len(held):
                text.seek(at + place)
                held, at, place = text.read(max(whole, READ)), at + place, 0
            span = held[place : place + whole]
            place += whole
            if role_at == IN_SPAN:
                role = role_of(span[:head].decode())
            elif (role_at, role_size) in roles:
                role = roles[role_at, role_size]
            else:
                if len(roles) >= 1024:
                    roles.clear()
                role = roles[role_at, role_size] = lying(role_at, role_size)
            said = lying(text_at, text_size) if text_at >= 0 else span[head:end].decode()
            yield role, unescape(said) if text_at == ESCAPED else said, bool(learnt), len(span.decode()) - lost
        at += place
        done += len(some)


def digests(portions: DataFrame, folder: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites) of each conversation, from the files.

    Nothing is learnt where the template rewrites history.
    """
    pieces = F.array_sort(F.collect_list(F.struct("part", "nth", "first_turn", "turns", "at")))
    convs = portions.groupBy("conv_id").agg(pieces.alias("pieces"), F.max("rewrites").alias("rewrites"))
    # A task for each file, however few rows tell of it: what counts is what it reads.
    parts = (portions.agg(F.max("part")).first()[0] or 0) + 1
    convs = convs.withColumn("part", F.col("pieces")[0]["part"]).repartitionByRange(parts, "part").sortWithinPartitions("part", F.col("pieces")[0]["at"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        opened: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                all_turns, learnt_text, n, learnt_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for p in row["pieces"]:
                    for role, text, learnt, size in read_turns(folder, p["part"], p["first_turn"], p["turns"], p["at"], opened):
                        all_turns.update(f"{role}\n{text}\n".encode())
                        n += 1
                        chars += size
                        if learnt and not row["rewrites"]:
                            learnt_text.update(text.encode())
                            learnt_chars += len(text)
                out.append((row["conv_id"], n, all_turns.hexdigest(), learnt_chars, learnt_text.hexdigest(), chars, row["rewrites"]))
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    return convs.select("conv_id", "pieces", "rewrites").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
