"""Chat formatting: typed content parts in a turn template with a loss mask, and reading it back."""

import hashlib
import math
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of the template. Inside texts a backslash goes after the first character of each,
# and of each that already has backslashes there, so that taking one away gives the text back.
USER, USER_END = "[INST] ", " [/INST]"
SYSTEM, SYSTEM_END = "<<SYS>>\n", "\n<</SYS>>\n"
ASSISTANT, ASSISTANT_END = " ", "</s>"
OTHER, OTHER_END = "<|role:{}|>", "<|end|>"
_TAIL = r"(?:/?s>|</?SYS>>|\|)"
_ESCAPE = re.compile(rf"<(?=\\*{_TAIL})|\[(?=\\*/?INST\])")
_UNESCAPE = re.compile(rf"(?<=<)\\(?=\\*{_TAIL})|(?<=\[)\\(?=\\*/?INST\])")
_OTHER = re.compile(r"<\|role(?::([^|]*))?\|>")
_PLACE = re.compile(r"<\|(image|audio|document|file):\d+\|>")

IMAGE_PATCH = 28  # pixels a side of an image patch, one token each
AUDIO_RATE = 25  # tokens a second
PAGE_TOKENS = 1024  # tokens a page

PARTS = ("array<struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>")
TURN = ("formatted string, loss array<struct<a:long,b:long>>, "
        "attachments array<struct<kind:string,ref:string,at:long,tokens:long>>, tokens long")


def escape(text):
    return _ESCAPE.sub(r"\g<0>\\", text)


def unescape(text):
    return _UNESCAPE.sub("", text)


class Flattener:
    """Visits the parts of a turn in order: texts are escaped, other parts become placeholders."""

    def __init__(self):
        self.out, self.size, self.held = [], 0, []
        self.texts, self.attachments = [], []

    def visit(self, part):
        kind = part["kind"] if part["kind"] in ("text", "image", "audio", "document") else "file"
        getattr(self, kind)(part)

    def text(self, part):
        self.held.append(part["text"] or "")  # neighbours are escaped as one: a control string may span them

    def image(self, part):
        patches = [math.ceil((part[side] or 0) / IMAGE_PATCH) for side in ("width", "height")]
        self._place("image", part, patches[0] * patches[1])

    def audio(self, part):
        self._place("audio", part, math.ceil((part["seconds"] or 0) * AUDIO_RATE))

    def document(self, part):
        self._place("document", part, (part["pages"] or 0) * PAGE_TOKENS)

    def file(self, part):
        self._place("file", part, 0)

    def _place(self, kind, part, tokens):
        self.flush()
        self.attachments.append({"kind": kind, "ref": part["ref"], "at": self.size, "tokens": tokens})
        self._put(f"<|{kind}:{len(self.attachments) - 1}|>")

    def _put(self, text):
        self.out.append(text)
        self.size += len(text)

    def flush(self):
        text, self.held = escape("".join(self.held)), []
        if text:
            self.texts.append((self.size, self.size + len(text)))
            self._put(text)


def _frame(role):
    if role == "user":
        return USER, USER_END
    if role == "system":
        return SYSTEM, SYSTEM_END
    if role == "assistant":
        return ASSISTANT, ASSISTANT_END
    return ("<|role|>" if role is None else OTHER.format(quote(role, safe=""))), OTHER_END


def format_turn(role, text=None, parts=None, learn=("assistant",)):
    """(formatted, loss spans, attachments, tokens) of one turn; offsets count code points in it."""
    visitor = Flattener()
    for part in parts if parts is not None else [{"kind": "text", "text": text}]:
        if part is not None:
            visitor.visit(part)
    visitor.flush()
    head, foot = _frame(role)
    shift = len(head)
    loss = [{"a": a + shift, "b": b + shift} for a, b in visitor.texts] if role in learn else []
    for place in visitor.attachments:
        place["at"] += shift
    return (head + "".join(visitor.out) + foot, loss, visitor.attachments,
            sum(place["tokens"] for place in visitor.attachments))


def read_turns(formatted):
    """The (role, text) of every turn of a formatted text, with placeholders left out."""
    at, turns = 0, []
    while at < len(formatted):
        other = _OTHER.match(formatted, at)
        if other:
            role, begin, foot = other[1], other.end(), OTHER_END
            role = None if role is None else unquote(role)
        else:
            role, head, foot = next(
                (r, *_frame(r)) for r in ("user", "system", "assistant") if formatted.startswith(_frame(r)[0], at))
            begin = at + len(head)
        end = formatted.index(foot, begin)
        turns.append((role, unescape(_PLACE.sub("", formatted[begin:end]))))
        at = end + len(foot)
    return turns


def format_conversations(turns: DataFrame, learn=("assistant",), conv_id="conv_id", turn="turn", role="role",
                         text="text", parts=None) -> DataFrame:
    """One row per turn: conv_id, turn, role, formatted, loss, attachments, tokens.

    The formatted texts of a conversation, in the order of turns, are its training text. `loss` has the
    spans of a turn's text that are learned from (roles in `learn`), in code points of `formatted`.
    `parts` names a column of typed parts (`PARTS`) to be used in place of the text: text, image, audio
    and document, in order; every attachment is a placeholder, listed in `attachments` with reference,
    offset and the tokens it expands to. Parts of other kinds are files without tokens.

    A row is formatted by itself, nothing is shuffled. Null text is empty, a null list of parts is one
    empty text, null parts are left out; a null role and roles other than user, assistant and system
    have their own marks. An empty table gives no rows. Other columns are not read.
    """
    rows = turns.select(*[F.col(c) for c in (conv_id, turn, role, parts or text)])
    rows = rows.toDF("conv_id", "turn", "role", "content")
    if parts:
        rows = rows.withColumn("content", F.col("content").cast(PARTS))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    types = [pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])),
             pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])),
             pa.int64()]

    def each(batches):
        for batch in batches:
            contents = batch.column(3).to_pylist()
            done = [format_turn(r, None if parts else c, (c or []) if parts else None, learn)
                    for r, c in zip(batch.column(2).to_pylist(), contents)]
            columns = zip(*done) if done else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(list(v), t) for v, t in zip(columns, types)]],
                names=["conv_id", "turn", "role", "formatted", "loss", "attachments", "tokens"])

    return rows.mapInArrow(each, f"{head}, {TURN}")


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(kind):
    def run(batches):
        held, own = [], None

        def close():
            key, count, turns, chars, loss, size = own
            held.append((key, count, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush():
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*held)) or [[]] * 6
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, types)], names=names)

        for batch in batches:
            for key, formatted, loss in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if own is None or own[0] != key:
                    if own is not None:
                        close()
                    own = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted):
                    own[1] += 1
                    own[2].update(f"{role or ''}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["a"] : span["b"]])
                    own[3] += len(text)
                    own[4].update(text.encode())
                own[5] += len(formatted)
            yield flush()
        if own is not None:
            close()
            yield flush()

    return run


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from `format_conversations`: its turns, texts and mask.

    A conversation's rows meet in one task, sorted by turn (nulls first, ties by formatted text), and
    stream through it: the state is two running hashes, never the conversation. A SHA-256 depends on all
    bytes before, so one conversation cannot be hashed by several tasks; formatting is spread evenly.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = formatted.select("conv_id", "formatted", "loss", "turn").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "formatted").drop("turn")
    key = rows.schema["conv_id"].dataType
    return rows.mapInArrow(_digests(to_arrow_type(key)), f"conv_id {key.simpleString()}, {DIGEST}")
