"""Token ids of whole texts by public tokenizer files, with a cache of units.

Both vocabularies cut a text at white space before any merge, and between a letter and a full stop
or comma, so a text is a row of *units* whose ids do not depend on their neighbours. Each distinct unit goes through the tokenizers library once
per worker; texts are then put together from cached ids by array arithmetic. Known words are an Arrow array with sorted hashes, so a batch's
distinct words are found by array searches, and what a hash finds is compared as text. Where that reasoning
does not hold (special-token strings, control characters that only one of the two sides calls
white space), the library gets the whole text. ``tests/llm`` holds both ways against each other.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: White space as in the Unicode property that the tokenizers' patterns use.
_WS = "\t-\r \x85\xa0  -     　"
_ODD_WS = "\t\x0b\x0c\r\x85\xa0  -     　"
#: Stands before a unit that has no space before it, in texts that were cut into units.
_BARE = "\x1e"
_ODD = f"[{_ODD_WS}{_BARE}]"
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The control characters that only Python calls white space.
_CONTROLS = "\x1c\x1d\x1e\x1f"
#: What the word tokenizer's pattern finds in such words in lower case, and the line breaks between words.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-z0-9ß-öø-ÿ]+")

#: Words that are one piece by either pattern; the word tokenizer's are in lower case.
_LETTERS = {"byte": f"^{_BARE}?[A-Za-zÀ-ÖØ-öø-ÿ]+$", "word": "^[a-zß-öø-ÿ]+$"}
#: Behind a Latin letter or digit both patterns cut before a full stop or comma; this finds one elsewhere.
_UNCUT = "(^|[^0-9A-Za-zÀ-ÖØ-öø-ÿ])[,.]"
#: In words of ASCII and Latin-1 letters no normalization reaches over their characters; this finds others.
_NOT_LATIN = "[^\\x00-\\x7fÀ-ÖØ-öø-ÿ]"
#: A file that cuts this otherwise than the pieces have it gets white-space units only.
_PROBE = "Word, wordNext. Été, straßeÀ a.b l'Un I'LL 3,5 été\nOther. FIN"


def _byte_characters() -> str:
    """The character of byte-level vocabularies for each byte, but for the space."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return "".join(" " if b == 32 else chr(256 + odd.index(b)) if b in odd else chr(b) for b in range(256))


_BYTES = _byte_characters()

#: Units beyond which those that only one batch used are dropped.
CACHE_UNITS = 1_200_000

_hash = xxhash.xxh3_64_intdigest


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Ids of many texts at once; ``style`` is "byte" (byte-level, white space is kept) or "word"
    (lower case, white space dropped)."""

    def __init__(self, path: str, style: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.style = Tokenizer.from_file(path), style
        # The same vocabulary and merges for what is one piece already: no pattern, no normalizing.
        # Each word goes there once, so a cache of the model's own would only cost time.
        self.pieces = Tokenizer(Tokenizer.from_file(path).model)
        self.pieces.model._resize_cache(0)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if style == "byte":
            size = self.tok.get_vocab_size()
            self.spaced = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
            self.line_break = self.tok.token_to_id("Ċ")
        else:
            self.last = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(self.tok.get_vocab_size())])
        self.by_piece = True
        self._clear()
        if self.encode([_PROBE])[0].tolist() != self.tok.encode(_PROBE, add_special_tokens=False).ids:
            self.by_piece = False
        self._clear()

    def _clear(self) -> None:
        self.words = pa.array([], pa.large_string())  # as they stand behind a space, or behind nothing where marked so
        self.word_units = np.zeros(0, np.int32)
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # the words' hashes in order, and the word of each
        self.exact: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int32)
        self.size = np.zeros(1 << 14, np.int32)
        self.born = np.zeros(1 << 14, np.int32)  # the batch that brought a unit, and the last one that used it
        self.used = np.zeros(1 << 14, np.int32)
        self.n_units = self.n_flat = self.batch = 0

    @property
    def after_space(self) -> list[str]:
        """The known words."""
        return self.words.to_pylist()

    def _add(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        """Store the ids of new units, one behind the other; returns the first unit's number."""
        total, first, end = len(flat), self.n_units, self.n_units + len(sizes)
        while self.n_flat + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while end > len(self.at):
            self.at, self.size, self.born, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.born, self.used))
        self.flat[self.n_flat : self.n_flat + total] = flat
        self.size[first:end] = sizes
        self.born[first:end] = self.used[first:end] = self.batch
        self.at[first:end] = self.n_flat + np.cumsum(sizes) - sizes
        self.n_flat, self.n_units = self.n_flat + total, end
        return first

    def _evict(self) -> None:
        """Keep the units that a batch used again since the last time, of too many the latest: most units
        are names and slips that never come back."""
        n = self.n_units
        stay = np.flatnonzero(self.used[:n] > self.born[:n])
        if len(stay) > CACHE_UNITS // 2:
            stay = np.sort(stay[np.argsort(self.used[stay], kind="stable")[-(CACHE_UNITS // 2) :]])
        size, at, used = self.size[stay], self.at[stay], self.used[stay]
        total = int(size.sum())
        flat = self.flat[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(total)]
        number = np.full(n, -1, np.int32)
        number[stay] = np.arange(len(stay))
        words, units, hashes, places, exact, batch = self.words, number[self.word_units], self.hashes, self.places, self.exact, self.batch
        self._clear()
        self._add(flat, size)
        self.born[: self.n_units] = self.used[: self.n_units] = used
        self.batch = batch
        held = units >= 0
        self.words, self.word_units = words.filter(pa.array(held)), units[held]
        self.hashes, self.places = hashes[held[places]], (np.cumsum(held, dtype=np.int32) - 1)[places[held[places]]]
        number = number.tolist()
        self.exact = {u: number[k] for u, k in exact.items() if number[k] >= 0}

    def _encode_each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _learn_exact(self, units: list[str]) -> None:
        new = [u for u in dict.fromkeys(units) if u not in self.exact]
        if new:
            first = self._add(*self._encode_each(new))
            self.exact.update(zip(new, range(first, first + len(new)), strict=True))

    def _learn_spaced(self, new: pa.Array) -> np.ndarray:
        """The units of distinct new words, learned as they stand behind a space, or behind nothing where marked so."""
        matches = lambda x: pc.match_substring_regex(new, x).to_numpy(zero_copy_only=False)
        letters = matches(_LETTERS[self.style]) if self.by_piece else np.zeros(len(new), bool)
        if self.style == "byte":
            bare = pc.starts_with(new, _BARE).to_numpy(zero_copy_only=False)
            ways = [
                (letters & ~bare, 0, self._encode_letters), (~letters & ~bare, 0, self._encode_spaced),
                (letters & bare, 1, self._encode_bare), (~letters & bare, 1, self._encode_each),
            ]
        else:
            plain = ~letters & ~matches(_NOT_LATIN) if self.by_piece else letters
            ways = [(letters, 0, self._encode_letters), (plain, 0, self._from_pieces), (~letters & ~plain, 0, self._encode_joined)]
        words = new.to_numpy(zero_copy_only=False)
        units = np.zeros(len(new), np.int32)
        for held, mark, encode in ways:
            if held.any():
                group = words[held].tolist()
                ids, sizes = encode([w[mark:] for w in group] if mark else group)
                units[held] = self._add(ids, sizes) + np.arange(len(group))
        return units

    def _spaced_units(self, parts: pa.Array) -> np.ndarray:
        """The unit of each word, the new ones learned."""
        coded = parts.dictionary_encode()
        kinds = coded.dictionary
        hashes = np.fromiter(map(_hash, kinds.to_numpy(zero_copy_only=False)), np.uint64, len(kinds))
        order = np.argsort(hashes)
        units = np.full(len(kinds), -1, np.int32)
        known = len(self.words)
        if known:
            at = np.minimum(np.searchsorted(self.hashes, hashes[order]), known - 1)
            found = self.hashes[at] == hashes[order]
            kind, place = order[found], self.places[at[found]]
            same = pc.equal(kinds.take(pa.array(kind)), self.words.take(pa.array(place))).to_numpy(zero_copy_only=False)
            units[kind[same]] = self.word_units[place[same]]
        new = order[units[order] < 0]
        if len(new):
            fresh = kinds.take(pa.array(new))
            units[new] = self._learn_spaced(fresh)
            self.words = pa.concat_arrays([self.words, fresh])
            self.word_units = np.concatenate([self.word_units, units[new]])
            spots = np.searchsorted(self.hashes, hashes[new])
            self.hashes = np.insert(self.hashes, spots, hashes[new])
            self.places = np.insert(self.places, spots, np.arange(known, known + len(new), dtype=np.int32))
        return units[coded.indices.to_numpy()]

    def _piece_ids(self, joined: str) -> np.ndarray:
        return np.array(self.pieces.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that are one piece each, as behind a space."""
        joined = codecs.charmap_decode(" ".join(words).encode(), "strict", _BYTES)[0]
        if self.style == "byte":
            ids = self._piece_ids("Ġ" + joined.replace(" ", " Ġ"))
            sizes = np.diff(np.flatnonzero(self.spaced[ids]), append=len(ids))
        else:
            # The last token of a piece tells where it ends.
            ids = self._piece_ids(joined)
            sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if len(sizes) == len(words) and sizes.sum() == len(ids):
            return ids, sizes
        return self._encode_spaced(words) if self.style == "byte" else self._encode_joined(words)

    def _encode_bare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of the byte-level tokenizer that are one piece each, behind nothing; a line break after each tells where it ends."""
        ids = self._piece_ids(codecs.charmap_decode(" ".join(words).encode(), "strict", _BYTES)[0].replace(" ", " Ċ ") + " Ċ")
        ends = np.flatnonzero(ids == self.line_break)
        if len(ends) != len(words):
            return self._encode_each(words)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _encode_spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of the byte-level tokenizer, as behind a space; one call if the spaces tell where they begin."""
        ids = np.array(self.tok.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.spaced[ids])
        if len(cuts) == len(words) and cuts[0] == 0:
            return ids, np.diff(cuts, append=len(ids))
        return self._encode_each([" " + u for u in words])

    def _store(self, table: dict[str, int], units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = self._add(ids, sizes)
        table.update(zip(units, range(first, first + len(units)), strict=True))

    def _encode_joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One call for all units of the word tokenizer: a token's place in the joined text tells its unit."""
        e = self.tok.encode(" ".join(units), add_special_tokens=False)
        starts = np.cumsum([0, *(len(u) + 1 for u in units[:-1])])
        owner = np.searchsorted(starts, np.fromiter((o[0] for o in e.offsets), np.int64, len(e)), "right") - 1
        return np.array(e.ids, np.uint32), np.bincount(owner, minlength=len(units))

    def _from_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin letters from the pieces that the tokenizer cuts them into: new words differ in capitals, digits
        and punctuation, and their pieces are mostly known. Only new pieces go to the library."""
        coded = pa.array(_PIECES.findall("\n".join(words).lower()), pa.large_string()).dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        units = self._lookup(self.exact, kinds)
        new = [u for u, k in zip(kinds, units, strict=True) if k < 0 and u != "\n"]
        if new:
            self._store(self.exact, new, *self._encode_letters(new))
            units = self._lookup(self.exact, kinds)
        self.used[units[units >= 0]] = self.batch
        units = units[coded.indices.to_numpy(zero_copy_only=False)]
        breaks = units < 0
        owner, units = np.cumsum(breaks)[~breaks], units[~breaks]
        size = self.size[units]
        ids = self.flat[np.repeat(self.at[units] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return ids, np.bincount(owner, size, len(words)).astype(np.int64)

    def _lookup(self, table: dict[str, int], parts: list[str]) -> np.ndarray:
        return np.fromiter(map(table.get, parts, repeat(-1)), np.int64, len(parts))

    def _split(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, dict, dict]:
        """``(counts, parts, other, whole)``: the words of all texts in a row and how many each has, the
        units of texts with other white space, and the ids of those that go to the library whole."""
        counts = np.zeros(len(texts), np.int64)
        other: dict[int, np.ndarray] = {}
        whole: dict[int, np.ndarray] = {}
        rows = pa.array(texts, pa.large_string())
        word = self.style == "word"
        odd, uncut = (pc.match_substring_regex(rows, x).to_pylist() for x in (_ODD, _UNCUT))
        foreign = pc.match_substring_regex(rows, _NOT_LATIN).to_pylist() if word else []
        if not self.by_piece:
            uncut = foreign = [True] * len(texts)
        at: list[int] = []
        plain: list[str] = []
        for k, t in enumerate(texts):
            if "<|" in t or word and any(c in t for c in _CONTROLS):
                whole[k] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            if word:
                # Space is dropped and case too, so words differ in neither, nor in what follows them.
                spaced = " ".join(t.split()) if odd[k] else t.replace("\n", " ")
                if not foreign[k]:
                    spaced = spaced.lower()
                if not uncut[k]:
                    spaced = spaced.replace(",", " ,").replace(".", " .")
            else:
                spaced = _BARE + t.replace("\n", f" {_BARE}\n {_BARE}")
                # Words with single spaces or line breaks between them leave no empty part.
                if odd[k] or not t or "  " in spaced or f"{_BARE} " in spaced or spaced[-1] in (" ", _BARE):
                    chunks = _CHUNK.findall(t)
                    self._learn_exact(chunks)
                    other[k] = self._lookup(self.exact, chunks)
                    continue
                if not uncut[k]:
                    spaced = spaced.replace(",", f" {_BARE},").replace(".", f" {_BARE}.")
            at.append(k)
            plain.append(spaced)
        rows = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        counts[at] = rows.value_lengths().to_numpy(zero_copy_only=False)
        return counts, rows.flatten(), other, whole

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many belong to each text."""
        self.batch += 1
        if self.n_units > CACHE_UNITS:
            self._evict()
        counts, parts, other, whole = self._split(texts)
        units = self._spaced_units(parts)
        if other:
            pieces, at = [], 0
            for k in range(len(texts)):
                if k in other:
                    pieces.append(other[k])
                    counts[k] = len(other[k])
                elif counts[k]:
                    pieces.append(units[at : at + counts[k]])
                    at += counts[k]
            units = np.concatenate(pieces) if pieces else units
        self.used[units] = self.batch
        size = self.size[units]
        upto = np.cumsum(size, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.flat[np.repeat((self.at[units] - (upto - size)).astype(np.int32), size) + np.arange(total, dtype=np.int32)]
        ends = np.concatenate([[0], upto])[np.cumsum(counts)]
        lengths = np.diff(np.concatenate([[0], ends]))
        if whole:
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for k, x in whole.items():
                parts[k], lengths[k] = x, len(x)
            ids = np.concatenate(parts)
        return ids, lengths


_encoders: dict[tuple[str, str], UnitEncoder] = {}


def encoder(path: str, style: str) -> UnitEncoder:
    """The worker's own encoder of that file; its cache lives as long as the worker."""
    if (path, style) not in _encoders:
        _encoders[path, style] = UnitEncoder(path, style)
    return _encoders[path, style]


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` behind each text's ids."""
    return np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def batches(texts: list[str | None], chars: int = 4_000_000):
    """Slices of at most about ``chars`` characters (one text at least), null as empty."""
    lo = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > lo and size + n > chars:
            yield lo, k
            lo, size = k, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
