"""Chat formatting by token-level assembly.

Each turn is assembled from ids: reserved ids mark its parts, and the role and the content are encoded each by itself, so
no marker can arise from text and no token spans two segments:

    BOS?  TURN  role ids  SAYS  content ids  END

Control strings that occur in a role or content are broken up before it is encoded (``ESCAPE`` is put before them and behind
their first character, and before an ``ESCAPE`` of the text), so that readers who look for them in decoded text find none. The loss
mask is +1 where an assistant's content begins and -1 where it ends, summed up along the ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import tokens_path

#: Reserved ids lie behind the vocabulary of the byte-level tokenizer, in this order; the strings mark them in decoded text.
RESERVED = ("<|bos|>", "<|turn|>", "<|says|>", "<|end|>")
#: Control strings of this and of common other templates.
CONTROL = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", *RESERVED)
ESCAPE = "\\"
LEARNED = "assistant"
_FIND = re.compile("|".join([re.escape(ESCAPE), *map(re.escape, sorted(CONTROL, key=lambda c: (-len(c), c)))]))


def escape(text: str) -> str:
    r"""``\`` becomes ``\\``, and a control string gets ``\`` before it and behind its first character: ``</s>`` is ``\<\/s>``."""
    return _FIND.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else ESCAPE + m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(re.escape(ESCAPE) + "(.)", r"\1", text, flags=re.DOTALL)


class ChatIds:
    """Encodes segments with the byte-level tokenizer, which gives back every text as it was."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        first = self.tokenizer.get_vocab_size()
        self.bos, self.turn, self.says, self.end = range(first, first + len(RESERVED))

    def segments(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def text(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


@cache
def chat_ids(path: str) -> ChatIds:
    return ChatIds(path)


def turn_ids(tok: ChatIds, role: list[int], content: list[int], learn: bool, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a turn and their loss mask (0 or 1)."""
    head = [tok.bos] * first + [tok.turn, *role, tok.says]
    ids = np.array([*head, *content, tok.end], "<u4")
    steps = np.zeros(len(ids) + 1, np.int64)
    steps[len(head)] += learn
    steps[len(head) + len(content)] -= learn
    return ids, np.cumsum(steps)[:-1].astype(np.uint8)


def assemble(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", path: str | None = None) -> DataFrame:
    """(conv_id, turn, place, ids, mask): a row per turn; a conversation is its rows' ids in order of ``place``.

    Turns are ordered by ``turn``, nulls first, equal ones by role and text. A null role or text is empty. Null
    ``conv_id`` is a conversation of its own. Rows of one conversation are read as a stream, so it may have any number of turns.
    Repeated rows are turns each. An empty table gives an empty table.
    """
    path = path or tokens_path("byte_bpe_50k.json")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, last, place = chat_ids(path), (), 0
        for batch in batches:
            roles, texts = tok.segments([escape(r) for r in batch["role"]]), tok.segments([escape(t) for t in batch["text"]])
            rows = []
            for conv, name, r, t in zip(batch["conv_id"].astype("Int64"), batch["role"], roles, texts):
                conv = None if conv is pd.NA else int(conv)
                place = place + 1 if (conv,) == last else 0
                last = (conv,)
                ids, mask = turn_ids(tok, r, t, name == LEARNED, place == 0)
                rows.append((place, ids.tobytes(), mask.tobytes()))
            out = pd.DataFrame(rows, columns=["place", "ids", "mask"])
            yield pd.concat([batch[["conv_id", "turn"]].astype("Int64").reset_index(drop=True), out], axis=1)

    own = turns.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    sorted_ = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_.mapInPandas(build, "conv_id long, turn long, place long, ids binary, mask binary")


def read_back(assembled: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the ids and masks alone.

    ``turns_sha256`` is of role, newline, text, newline of each turn; ``loss_*`` of the text under the mask, unescaped;
    ``formatted_chars`` counts the code points of the decoded ids with the markers.
    """
    path = path or tokens_path("byte_bpe_50k.json")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, now, state = chat_ids(path), (), None

        def done() -> pd.DataFrame:
            n, turns, chars, loss, total = state
            row = {"conv_id": pd.array([now[0]], "Int64"), "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [total]}
            return pd.DataFrame(row)

        for batch in batches:
            finished = []
            for conv, ids, mask in zip(batch["conv_id"].astype("Int64"), batch["ids"], batch["mask"]):
                conv = None if conv is pd.NA else int(conv)
                if (conv,) != now:
                    if state:
                        finished.append(done())
                    now, state = (conv,), [0, sha256(), 0, sha256(), 0]
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8)
                marks = np.flatnonzero(ids >= tok.bos)
                start, says, end = marks[-3:]
                role, content = tok.text(ids[start + 1 : says]), tok.text(ids[says + 1 : end])
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(content)}\n".encode("utf-8", "surrogatepass"))
                learned = unescape(tok.text(ids[mask == 1]))
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(role) + len(content) + sum(len(RESERVED[int(i) - tok.bos]) for i in ids[marks])
            if finished:
                yield pd.concat(finished)
        if state:
            yield done()

    ordered = assembled.select("conv_id", "place", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
