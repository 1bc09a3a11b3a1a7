"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies with byte fallback.

A chunk's symbols start as single characters; an agenda ordered by piece score (ties: leftmost) holds the
adjacent pairs whose join is a piece, and the best pair is merged until none is left. Pieces never hold a
word mark after another character, so a text splits before each run of word marks (spaces, or the mark itself,
which the library does not tell apart) into chunks that merge independently; each distinct chunk goes through
the agenda once and is kept in a bounded table. Short chunks keep the agenda as a flat list, long ones as a heap.

Checks against the sentencepiece library, in the Arrow batch where something first comes up: each distinct chunk both
ways, but chunks of letters and closing marks that no piece holds after a letter in two parts (the letters both ways, the marks
after one letter by ids), as no merge can cross the two; and of each run of texts that learn together the first text and every text
that holds the mark or a control character as a whole, both ways. Where a chunk or a whole text differs the library's answer
is used and counted in `n_library`.

Null and empty texts have no ids and decode to the empty text. Very long texts are encoded whole, by their chunks. Repeated
rows get equal results; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import gaps, held, in_arrow, without_gc

MARK = "▁"
#: Chunks kept by a Python worker; a full table is emptied and fills again.
TABLE_CHUNKS = 400_000

#: Symbols up to which the agenda is a flat list.
SHORT = 40
_NONE = float("inf")
_CHUNKS = re.compile(" +[^ ]*")
#: Texts that are checked as a whole whatever their place.
_ODD = re.compile(f"[{MARK}\x00-\x08\x0b-\x1f\x7f-\x9f\u2000-\u200f\u2028-\u202f]")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder over one vocabulary, read through the library's piece table."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        whole = [i for i in range(len(self.pieces)) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.id = {self.pieces[i]: i for i in whole}
        #: Agenda priority: the highest score first.
        self.rank = {self.pieces[i]: -library.get_score(i) for i in whole}
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        self.unknown = library.unk_id()

    def merge(self, text: str) -> list[str]:
        """Pieces and left-over characters of a marked text."""
        symbols: list[str | None] = list(text)
        n, rank = len(symbols), self.rank.get
        if n <= SHORT:  # the agenda of a short text is a flat list: its least entry is found faster than a heap is kept
            pairs = [rank(a + b, _NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
            while pairs and (best := min(pairs)) != _NONE:
                i = pairs.index(best)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = rank(symbols[i] + symbols[i + 1], _NONE)
                if i:
                    pairs[i - 1] = rank(symbols[i - 1] + symbols[i], _NONE)
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (r := rank(pair)) is not None:
                agenda.append((r, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != pair:
                continue  # one of its symbols has been merged meanwhile
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(joined := pair + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, joined))
            if (h := before[i]) >= 0 and (r := rank(joined := symbols[h] + pair)) is not None:
                heapq.heappush(agenda, (r, h, joined))
        return [s for s in symbols if s is not None]

    def encode_marked(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.merge(text):
            if (i := self.id.get(piece)) is not None:
                ids.append(i)
            elif self.byte:
                ids.extend(self.byte[b] for b in piece.encode())
            else:
                ids.append(self.unknown)
        return ids

    def decode_marked(self, ids: list[int]) -> str:
        """Text of ids, word marks as spaces; runs of byte pieces are UTF-8, each undecodable byte a replacement character."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(self.pieces[i].replace(MARK, " "))
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, by one agenda."""
        return self.encode_marked(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: list[int]) -> str:
        text = self.decode_marked(ids)
        return text[1:] if text.startswith(" ") else text


def _utf8(raw: bytearray) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


#: Letters, and marks that may follow them, which are looked up apart where no piece joins the two.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,!?;:|$%&*#"


class Table:
    """Checked results of distinct chunks: ids as decimal text, and the decoded chunk where it isn't the chunk itself.

    Most chunks are letters and closing marks. Where the vocabulary has no piece in which such a mark follows a letter, no merge
    crosses from one to the other, and each run of letters goes through the agenda once, whatever follows it.
    """

    def __init__(self, model: str):
        self.codec = Codec(model)
        marks = "".join(m for m in _MARKS if not any(re.search(f"[{_LETTERS}]{re.escape(m)}", p) for p in self.codec.id))
        self.plain = re.compile(f"([{_LETTERS}]+)([{re.escape(marks)}]*)" if marks else f"([{_LETTERS}]+)()")
        self.ids: dict[str, str] = {}
        self.runs: dict[str, str] = {}
        self.marks: dict[str, str] = {"": ""}
        self.odd: dict[str, str] = {}
        self.corrected: set[str] = set()

    def chunks(self, text: str) -> list[str]:
        """The text's chunks, each without its first space; the mark itself is a space."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if not self.codec.splits:
            return [text]
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in _CHUNKS.findall(" " + text)]
        return text.split(" ")

    def text(self, chunks: list[str]) -> str:
        """The decoded text of chunks."""
        if self.odd:
            joint = "".join(self.odd.get(x, " " + x) for x in chunks)
            return joint[1:] if joint.startswith(" ") else joint
        return " ".join(chunks)

    def _checked(self, chunks: list[str]) -> list[str]:
        """Ids of chunks by the agenda, each compared with the library both ways."""
        codec, out = self.codec, []
        # an empty chunk is a lone space; the library adds no mark to an empty text
        theirs = codec.library.encode(chunks, num_threads=1)
        their_back = codec.library.decode(theirs, num_threads=1)
        for chunk, lib, lib_text in zip(chunks, theirs, their_back, strict=True):
            ids = codec.encode_marked(MARK + chunk.replace(" ", MARK))
            text = codec.decode_marked(ids)
            if chunk and (ids != lib or text[1:] != lib_text):
                self.corrected.add(chunk)
                ids, text = lib, " " + lib_text
            if text != " " + chunk:
                self.odd[chunk] = text
            out.append(",".join(map(str, ids)))
        return out

    def _follow(self, marks: str) -> str:
        """Ids of marks after letters, with a leading comma; the library shows them after one letter."""
        ids, library = self.codec.encode_marked(marks), self.codec.library
        if library.encode("a" + marks) != library.encode("a") + ids:
            raise ValueError(f"the library joins letters with {marks}")
        return "".join(f",{i}" for i in ids)

    def learn(self, new: set[str]) -> None:
        """Encode, decode and check chunks that the table lacks."""
        plain, other, match = [], [], self.plain.fullmatch
        for chunk in new:
            if (m := match(chunk)) is not None:
                plain.append((chunk, m[1], m[2]))
            else:
                other.append(chunk)
        if other:
            self.ids.update(zip(other, self._checked(other), strict=True))
        runs, marks = self.runs, self.marks
        if fresh := list({x[1] for x in plain}.difference(runs)):
            runs.update(zip(fresh, self._checked(fresh), strict=True))
        for x in {x[2] for x in plain}.difference(marks):
            marks[x] = self._follow(x)
        self.ids.update((chunk, runs[letters] + marks[mark]) for chunk, letters, mark in plain)
        if self.odd or self.corrected:
            for chunk, letters, mark in plain:
                if letters in self.odd:
                    self.odd[chunk] = self.odd[letters] + mark
                if letters in self.corrected:
                    self.corrected.add(chunk)

    def differing(self, texts: list[str], chunks: list[list[str]], ids: list[str]) -> dict[int, tuple[str, str]]:
        """The library's ids and text for those whole texts, of the ones that are checked so, where they differ."""
        picked = [k for k, t in enumerate(texts) if t and (k == 0 or _ODD.search(t))]
        if not picked:
            return {}
        theirs = self.codec.library.encode([texts[k] for k in picked], num_threads=1)
        back = self.codec.library.decode(theirs, num_threads=1)
        joint = [",".join(map(str, x)) for x in theirs]
        return {k: (x, t) for k, x, t in zip(picked, joint, back, strict=True) if x != ids[k] or t != self.text(chunks[k])}

    def encode(self, texts: list[list[str]]) -> list[str]:
        """Decimal ids of each text's chunks; what the table lacks is learned together."""
        with without_gc():
            return self._encoded(texts)

    def _make_room(self) -> None:
        if max(len(self.ids), len(self.runs)) > TABLE_CHUNKS:
            self.ids, self.runs, self.marks, self.odd, self.corrected = {}, {}, {"": ""}, {}, set()

    def _encoded(self, texts: list[list[str]]) -> list[str]:
        # emptied here, before these texts look anything up, so that what they find has all that belongs to it
        self._make_room()
        found = [list(map(self.ids.get, chunks)) for chunks in texts]
        holes = [list(gaps(own)) for own in found]
        if new := {chunks[k] for chunks, own in zip(texts, holes, strict=True) for k in own}:
            self.learn(new)
            for chunks, own, at in zip(texts, found, holes, strict=True):
                for k in at:
                    own[k] = self.ids[chunks[k]]
        return [",".join(own) for own in found]


def table_for(model: str) -> Table:
    return held("sentencepiece", model, lambda: Table(model))


def encoded(docs: DataFrame, model: str | None = None, texts: bool = False) -> DataFrame:
    """One row per document: ids (or, without texts, their digest only), their number, and the digest of the decoded text."""
    model = model or default_model()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_library long" + ", ids array<int>, decoded string" * texts

    def run(batches):
        table = table_for(model)
        for batch in batches:
            rows = batch.num_rows
            all_ids, all_texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < rows:
                found, size, first = [], 0, at
                while at < rows and size < 200_000:  # chunks learned together
                    found.append(table.chunks(all_texts[at] or ""))
                    size += len(found[-1])
                    at += 1
                out: dict[str, list] = {"n": [], "i": [], "d": [], "l": [], "ids": [], "text": []}
                encoded_texts = table.encode(found)
                differing = table.differing([x or "" for x in all_texts[first:at]], found, encoded_texts)
                for k, (chunks, ids) in enumerate(zip(found, encoded_texts, strict=True)):
                    ids, text = differing[k] if k in differing else (ids, table.text(chunks))
                    out["n"].append(ids.count(",") + 1 if ids else 0)
                    out["i"].append(hashlib.sha256(ids.encode()).hexdigest())
                    out["d"].append(hashlib.sha256(text.encode()).hexdigest())
                    out["l"].append((k in differing) + (sum(map(table.corrected.__contains__, chunks)) if table.corrected else 0))
                    if texts:
                        out["ids"].append([int(x) for x in ids.split(",")] if ids else [])
                        out["text"].append(text)
                columns = [all_ids.slice(first, at - first), pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()), pa.array(out["d"], pa.string()), pa.array(out["l"], pa.int64())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_library"]
                if texts:
                    columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["text"], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema, "sentencepiece")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: ids and decoded texts of every document, as digests."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
