"""Fast exact encoding with files of the ``tokenizers`` library.

A pre-token never crosses the places where the text is cut here (before a single blank, around a single line
feed), so encoding the pieces and joining their ids equals encoding the text. Distinct pieces of Latin letters and
ASCII marks behind them are encoded here, many words at a time, with the file's own merges; all others by the library,
whose ids are remembered, up to a fixed number of pieces, by the worker process. Texts
that hold an added token (``<|endoftext|>``) go to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Remembered pieces a worker, at about 150 bytes; pieces that the library encodes as one text.
MOST, TOGETHER = 500_000, 64
#: A piece that is Latin letters, then ASCII marks, but no apostrophe, which may begin a pre-token with letters. The letters are those of
#: Unicode 5 below U+0250 that have one lower form of one character, so not U+0130; none of them is composed with another.
PLAIN = r"\A(?P<feed>\n?)(?P<core>[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)\z"
#: Letters of the longest word, and number of words, that are merged here together: a round handles all of them for one merge each.
LONGEST, WORDS = 64, 16_384


class Merges:
    """A file's byte pair merges, applied to many words at once; ``of`` is None if the file has anything else to it."""

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    BITS, SLOTS, NONE = 21, 19, np.uint64((1 << 64) - 1)
    _ODD, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 21) - 1)
    #: Rank of a pair that isn't merged.
    NEVER = 1 << 30

    @classmethod
    def of(cls, file: dict) -> Merges | None:
        """Merges of a file whose pre-tokens are runs of letters, or of marks, in one of the two known ways."""
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
        lower = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
        split = {"type": "Split", "pattern": {"Regex": cls.SPLIT}, "behavior": "Removed", "invert": True}
        known = [(None, level | {"use_regex": True}), (lower, {"type": "Sequence", "pretokenizers": [split, level | {"use_regex": False}]})]
        model, way = file["model"], (file.get("normalizer"), file.get("pre_tokenizer"))
        if way not in known or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return None
        if file.get("post_processor") or file.get("truncation") or file.get("padding"):
            return None
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # the characters that stand for bytes
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = dict(zip([*own, *(b for b in range(256) if b not in own)], map(chr, [*own, *range(256, 324)]), strict=True))
        made: dict[str, int] = {}
        for r, (a, b) in enumerate(merges):
            made[a + b] = r
        # a merge comes after those that make its parts, so a merge never gives rise to an earlier one
        if any(max(made.get(a, -1), made.get(b, -1)) >= r for r, (a, b) in enumerate(merges)) or len(set(merges)) != len(merges):
            return None
        if any(x + e not in vocab for x in chars.values() for e in ("", end)) or any(a + b not in vocab for a, b in merges) or max(len(merges), *vocab.values()) > cls._LOW:
            return None
        return cls(vocab, merges, [chars[b] for b in range(256)], end, way[0] is not None)

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], chars: list[str], end: str, lower: bool):
        self.lower = lower
        self.first, self.last = (np.array([vocab[c + e] for c in chars], np.uint32) for e in ("", end))
        self.made = np.array([vocab[a + b] for a, b in merges], np.uint32)
        key = np.array([vocab[a] << self.BITS | vocab[b] for a, b in merges], np.uint64)
        # open addressing; a slot holds a pair and its rank
        self.slots = np.full((1 << self.SLOTS) if len(key) < 1 << (self.SLOTS - 2) else 4 << len(key).bit_length(), self.NONE)
        self.shift = np.uint64(65 - len(self.slots).bit_length())
        for at, entry in zip((key * self._ODD >> self.shift).tolist(), (key << np.uint64(self.BITS) | np.arange(len(key), dtype=np.uint64)).tolist(), strict=True):
            while self.slots[at] != self.NONE:
                at = (at + 1) % len(self.slots)
            self.slots[at] = entry

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair."""
        bits = np.uint64(self.BITS)
        key = a.astype(np.uint64) << bits | b
        at = (key * self._ODD >> self.shift).astype(np.int64)
        entry = self.slots[at]
        same = entry >> bits == key
        out = np.where(same, entry & self._LOW, self.NEVER).astype(np.int32)
        left = np.flatnonzero(~same & (entry != self.NONE))
        while len(left):
            at[left] = (at[left] + 1) % len(self.slots)
            entry = self.slots[at[left]]
            same = entry >> bits == key[left]
            out[left[same]] = entry[same] & self._LOW
            left = left[~same & (entry != self.NONE)]
        return out

    def ids(self, words: pa.Array) -> pa.Array:
        """The ids (little-endian) of large strings, none null or empty, each a whole pre-token."""
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1]
        raw = np.frombuffer(words.buffers()[2], np.uint8)
        parts = [self._some(raw[ends[i] : ends[j]], np.diff(ends[i : j + 1])) for i in range(0, len(words), WORDS) for j in (min(i + WORDS, len(words)),)]
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.concatenate([n for n, _ in parts]) * 4, out=at[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(at), pa.py_buffer(np.concatenate([x for _, x in parts]))])

    def _some(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of words with ``sizes`` bytes each, and the ids."""
        ends, count = np.cumsum(sizes), len(sizes)
        sym = self.first[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        own, starts = np.arange(count), ends - sizes
        rank = np.full(len(sym), self.NEVER, np.int32)
        rank[:-1] = self._ranks(sym[:-1], sym[1:])
        rank[starts + sizes - 1] = self.NEVER
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(own):
            least = np.minimum.reduceat(rank, starts)
            open_ = least < self.NEVER
            if not open_.all():
                keep = np.repeat(open_, sizes)
                done.append((own[~open_], sizes[~open_], sym[~keep]))
                sym, rank, own, sizes, least = sym[keep], rank[keep], own[open_], sizes[open_], least[open_]
                starts = np.cumsum(sizes) - sizes
                if not len(own):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            near = np.diff(at, prepend=-2) == 1
            if near.any():  # of pairs that share a symbol the left one is merged
                run = np.maximum.accumulate(np.where(near, -1, at))
                at = at[(at - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            # a merged pair's right symbol goes, with the rank of the pair that it began; whether that was its word's last stays to be seen
            final = np.zeros(len(sym), bool)
            final[starts + sizes - 1] = True
            final[at] = final[at + 1]
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            sizes = np.add.reduceat(kept, starts, dtype=np.int64)
            new = np.cumsum(kept)[at] - 1
            sym, rank, final = sym[kept], rank[kept], final[kept]
            starts = np.cumsum(sizes) - sizes
            rank[new] = self.NEVER
            ask = np.concatenate([new, new[new > 0] - 1])
            ask = ask[~final[ask]]
            rank[ask] = self._ranks(sym[ask], sym[ask + 1])
        sizes, placed = np.empty(count, np.int64), np.empty(sum(len(s) for _, _, s in done), "<u4")
        for w, n, _ in done:
            sizes[w] = n
        starts = np.cumsum(sizes) - sizes
        for w, n, s in done:
            placed[np.repeat(starts[w] - (np.cumsum(n) - n), n) + np.arange(len(s))] = s
        return sizes, placed


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers; None counts as empty."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = list(self.tok.get_added_tokens_decoder().values())
        self.added, self.folded = [a.content for a in added if not a.normalized], [a.content.lower() for a in added if a.normalized]
        # what all added tokens begin with, as far as it has no case: a text without it holds none of them
        self.lead = os.path.commonprefix([a.content for a in added]) if added else None
        self.lead = self.lead[: next((i for i, c in enumerate(self.lead) if c.lower() != c.upper()), len(self.lead))] if self.lead else self.lead
        self.spaced = self._raw(["a b"])[0] != b"".join(self._raw(["a", "b"]))
        self.feed = self._raw(["a\nb"])[0][len(self._raw(["a"])[0]) : -len(self._raw(["b"])[0])]
        # pieces are encoded together with a token between them that is always one of its own
        self.between, sep = ("\n", self.feed) if self.spaced else (" ~ ", self._raw(["~"])[0])
        self.sep = int.from_bytes(sep, "little") if len(sep) == 4 else None
        self.ids: dict[str, bytes] = {}
        self.odd: set[str] = set()
        with open(path, encoding="utf-8") as f:
            self.merges = Merges.of(json.load(f))
        self.tails: dict[str, bytes] = {"": b""}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str], lead: str) -> list[bytes]:
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out: list[bytes] = []
        between = self.between + lead
        for group, e in zip(groups, self.tok.encode_batch_fast([lead + between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(ids == self.sep)
            if len(at) != len(group) - 1:
                out += self._raw([lead + w for w in group])
                continue
            raw, ends = ids.tobytes(), (4 * at).tolist()
            out += [raw[a:b] for a, b in zip([0, *[x + 4 for x in ends]], [*ends, len(raw)], strict=True)]
        return out

    def _known(self, pieces: pa.Array) -> pa.Array:
        """The ids of pieces that :meth:`_learn` learns."""
        each = pieces.to_numpy(zero_copy_only=False).tolist()
        self._learn(set(each))
        return pa.array([self.ids[x] for x in each], pa.large_binary())

    def _distinct(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces: those of letters, and marks behind them, are merged here."""
        if not self.merges:
            return self._known(pieces)
        parts = pc.extract_regex(pieces, PLAIN)
        fit = pc.and_(pc.is_valid(parts), pc.less_equal(pc.utf8_length(parts.field("core")), LONGEST))
        mask = fit.to_numpy(zero_copy_only=False)
        rest = self._known(pieces.filter(pc.invert(fit)))
        feed, core, tail = (parts.field(x).filter(fit) for x in ("feed", "core", "tail"))
        if not len(core):
            return rest
        if self.merges.lower:
            core = pc.utf8_lower(core)
        behind = pc.equal(feed, "\n")
        if self.spaced:
            core = pc.binary_join_element_wise(pc.if_else(behind, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())), core, pa.scalar("", pa.large_string()))
        core, tail = core.dictionary_encode(), tail.dictionary_encode()
        if len(self.tails) > MOST:
            self.tails = {"": b""}
        ends = tail.dictionary.to_pylist()
        new = [t for t in ends if t not in self.tails]
        self.tails.update(zip(new, self._raw(new), strict=True))
        none, kind = pa.scalar(b"", pa.large_binary()), pa.large_binary()
        front = pc.if_else(behind, pa.scalar(self.feed, kind), none)
        own = pc.binary_join_element_wise(front, self.merges.ids(core.dictionary).take(core.indices), pa.array([self.tails[t] for t in ends], kind).take(tail.indices), none)
        return pa.concat_arrays([own, rest]).take(pa.array(np.where(mask, np.cumsum(mask) - 1, len(own) + np.cumsum(~mask) - 1)))

    def _learn(self, new: set[str]) -> None:
        todo = new.difference(self.ids)
        if len(self.ids) + len(todo) > MOST:
            self.ids.clear()
            self.odd.clear()
            todo = new
        starts = [w for w in todo if w[0] == "\n"]
        for key, lead, front, words in (("", " " if self.spaced else "", b"", list(todo.difference(starts))), ("\n", "", self.feed, [w[1:] for w in starts])):
            if len("".join(words).split()) > 1:  # white space other than the blanks and line feeds at which the text was cut
                other = [w for w in words if w.split() != [w]]
                self.odd.update(key + w for w in other)
                self.ids.update(zip([key + w for w in other], self._raw([lead + w for w in other]), strict=True))
                words = [w for w in words if w.split() == [w]]
            for i in range(0, len(words), 16_384):
                part = words[i : i + 16_384]
                found = self._pieces(part, lead) if self.sep is not None else self._raw([lead + w for w in part])
                self.ids.update(zip([key + w for w in part], [front + x for x in found], strict=True) if key else zip(part, found, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, cut, whole = [], [], []
        for i, t in enumerate(texts):
            if t and self.lead is not None and self.lead in t and (any(a in t for a in self.added) or self.folded and any(a in low for low in (t.lower(),) for a in self.folded)):
                whole.append(i)  # an added token is found before the text is cut into pre-tokens
            elif t:
                # a piece begins with a line feed if it stood behind one; the first is treated so too
                x = "\n" + t.replace("\n", " \n") if self.spaced else t.replace("\n", " ")
                if "  " in x or x[0] == " " or x[-1] == " " or self.spaced and (x.startswith("\n ") or x.endswith(" \n") or " \n " in x):
                    whole.append(i)  # blanks or line feeds that aren't single, or at an end
                else:
                    plain.append(i)
                    cut.append(x)
        if plain:
            # Arrow numbers the pieces and puts their ids behind each other, so that a distinct piece is one object here
            pieces = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
            ends, coded = pieces.offsets.to_numpy(), pieces.values.dictionary_encode()
            ids = self._distinct(coded.dictionary).take(coded.indices)
            at = np.frombuffer(ids.buffers()[1], np.int64)[ends]
            odd = np.zeros(len(plain), bool)
            if self.odd:
                rare = pc.is_in(coded.dictionary, pa.array(list(self.odd), pa.large_string())).to_numpy(zero_copy_only=False)
                odd = np.logical_or.reduceat(rare[coded.indices.to_numpy()], ends[:-1])
            raw, skip = memoryview(ids.buffers()[2] or b""), len(self.feed) if self.spaced else 0
            for i, o, lo, hi in zip(plain, odd.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if o:
                    whole.append(i)
                else:
                    out[i] = bytes(raw[lo + skip : hi])
        for i, ids in zip(whole, self._raw([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


class PieceCounts:
    """Numbers of tokens under several byte-level BPE vocabularies (``tiktoken`` files) at a time.

    A text is cut where :class:`Encoder` cuts it; the numbers of a piece under all vocabularies are one integer, ``BITS`` bits
    each, so a text's numbers are one sum. No special tokens: their strings are ordinary text.
    """

    BITS = 40

    def __init__(self, paths: tuple[str, ...]):
        import base64

        import public_tokenizers
        import tiktoken

        self.encodings = []
        for path in paths:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f.read().splitlines() if line)}
            self.encodings.append(tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
        self.feed = self._numbers(["\n"])[0]
        self.numbers: dict[str, int] = {}
        self.odd: set[str] = set()

    def _numbers(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for k, e in enumerate(self.encodings):
            for i, ids in enumerate(map(e.encode_ordinary, texts)):
                out[i] += len(ids) << k * self.BITS
        return out

    def _learn(self, seen: set[str]) -> None:
        if len(self.numbers) > MOST:
            self.numbers.clear()
            self.odd.clear()
        new = list(seen.difference(self.numbers))
        plain = [w.removeprefix("\n") for w in new]
        self.odd.update(w for w, p in zip(new, plain, strict=True) if p.split() != [p])
        after = self._numbers([p if w[0] == "\n" else " " + p for w, p in zip(new, plain, strict=True)])
        self.numbers.update((w, n + self.feed if w[0] == "\n" else n) for w, n in zip(new, after, strict=True))

    def count(self, texts: list[str | None]) -> list[list[int]]:
        """For each text its number of tokens under each vocabulary; None counts as empty."""
        sums, plain, whole, seen = [0] * len(texts), [], [], set()
        for i, t in enumerate(texts):
            if t:
                x = ("\n" + t.replace("\n", " \n")).split(" ")
                if "" in x or "\n" in x:  # blanks or line feeds that aren't single, or at an end
                    whole.append(i)
                else:
                    plain.append((i, x))
                    seen.update(x)
        self._learn(seen)
        odd, get = self.odd & seen, self.numbers.__getitem__
        for i, x in plain:
            if odd and not odd.isdisjoint(x):
                whole.append(i)
            else:
                sums[i] = sum(map(get, x)) - self.feed
        for i, n in zip(whole, self._numbers([texts[i] for i in whole]), strict=True):
            sums[i] = n
        mask = (1 << self.BITS) - 1
        return [[n >> k * self.BITS & mask for k in range(len(self.encodings))] for n in sums]


_ENCODERS: dict[str, Encoder] = {}
_COUNTS: dict[tuple[str, ...], PieceCounts] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def piece_counts(paths: tuple[str, ...]) -> PieceCounts:
    """The process's counts for some files."""
    if paths not in _COUNTS:
        _COUNTS[paths] = PieceCounts(paths)
    return _COUNTS[paths]


def public(name: str) -> str:
    """Path of a file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
