"""BPE encoding and decoding by speculation and verification.

Each distinct word is first cut greedily into its longest tokens: all words walk one trie at once, a byte a step. A cut is what merging
would give if and only if each pair of adjacent tokens is compatible: merging the two tokens' own text gives these two again. The adjacent
pairs of all words are looked up in a sorted table of known pairs at once; unknown pairs are decided once by exact merging and remembered.
Only words with an incompatible pair, or with a token that doesn't merge to itself, are merged exactly, many words of one length a step.

The vocabulary is a file of the tokenizers library: BPE with word ends, byte alphabet, NFC, lower case. Its path is a parameter.
Nulls: a null text counts as empty and gives no ids. White space gives no ids. Special tokens' strings in a text become their ids. Null ids
are kept, repeated rows are encoded alike, an empty table gives an empty table, further columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import PIECE_BYTES, bytes_of, coded, in_lines, pieces, plain, ragged

#: Pairs of tokens that a Python worker remembers; beyond that it keeps those of the words at hand.
REMEMBERED = 1_600_000
#: Bytes of the words that are cut and merged many at a time; longer ones are taken one by one.
WIDE = 64
END = "</w>"


def firsts(counts: np.ndarray) -> np.ndarray:
    """Where each run begins, and the end of the last."""
    return np.concatenate([[0], np.cumsum(counts)])


class Places:
    """Non-negative integers in a table of open addressing: the places of many at once, -1 for those that aren't there."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.place = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            self.place[slot[free]] = free  # of several for one slot, one gets it
            self.key[slot[free]] = keys[self.place[slot[free]]]
            todo = todo[self.place[slot[todo]] != todo]
            slot[todo] = slot[todo] + 1 & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        got = self.key[slot]
        out = np.where(got == keys, self.place[slot], -1)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.last
            got = self.key[slot[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.place[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@cache
def newer() -> list[int]:
    """Letters and digits of the regex library that unicodedata, whose Unicode is the tokenizers library's, doesn't have."""
    every = "".join(map(chr, (c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)))
    return [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c)[0] not in "LN"]


def ranges(codes: list[int]) -> str:
    """Sorted code points as ranges of a pattern's set."""
    ends = [i for i in range(len(codes)) if i + 1 == len(codes) or codes[i + 1] != codes[i] + 1]
    begins = [0, *(i + 1 for i in ends[:-1])]
    return "".join(f"\\U{codes[b]:08x}-\\U{codes[e]:08x}" for b, e in zip(begins, ends, strict=True)) if codes else ""


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.longest: dict[str, int] = {}  # by the first two characters
        for t in self.vocab:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), len(t))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(pattern)
        self.newer_letters = frozenset(map(chr, newer()))
        own = ranges(newer())
        older = pattern
        if own:
            older = older.replace(r"[\p{L}]", r"\p{L}").replace(r"[^\p{White_Space}\p{L}\p{N}]", f"(?:[^\\p{{White_Space}}\\p{{L}}\\p{{N}}]|[{own}])")
            older = regex.sub(r"(?<!\])\\p\{([LN])\}(?=\+|\|)", lambda m: f"[\\p{{{m[1]}}}--[{own}]]", older.replace(r"[\p{N}]", r"\p{N}"))
        self.split_newer = regex.compile("(?V1)" + older)
        self.split_lines = regex.compile(r"\n|" + pattern)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.size = max(self.tokens) + 1
        self.known = np.zeros(0, dtype=np.int64)  # pairs a * size + b, sorted
        self.fits = np.zeros(0, dtype=bool)
        self.exact_words = self.all_words = 0
        self._tables()

    def _tables(self) -> None:
        """The trie, the merges and the tokens' own symbols as arrays. A byte without a token of its own is a symbol from `size` on, dropped in the end."""
        of_byte = {c: b for b, c in enumerate(self.alphabet)}
        self.inner = np.array([self.vocab.get(c, self.size + b) for b, c in enumerate(self.alphabet)])
        self.closing = np.array([self.vocab.get(c + END, self.size + 256 + b) for b, c in enumerate(self.alphabet)])
        ranked = sorted(self.rank, key=self.rank.get)
        held = [(self.vocab[a] * self.size + self.vocab[b], self.vocab[a + b]) for a, b in ranked]
        self.merges, self.merged_to = Places(np.array([k for k, _ in held], dtype=np.int64)), np.array([t for _, t in held], dtype=np.int64)
        children: list[dict[int, int]] = [{}]
        tokens: list[list[int]] = [[-1, -1]]  # of each node, the token inside a word and that at its end
        own: list[tuple[int, bytes, bool]] = []
        for t, i in self.vocab.items():
            ends = t.endswith(END) and len(t) > len(END)
            data = [of_byte.get(c, -1) for c in (t[: -len(END)] if ends else t)]
            if not data or min(data) < 0:
                continue
            own.append((i, bytes(data), ends))
            n = 0
            for b in data:
                if b not in children[n]:
                    children[n][b] = len(children)
                    children.append({})
                    tokens.append([-1, -1])
                n = children[n][b]
            tokens[n][ends] = i
        steps = [(n * 256 + b, m) for n, kids in enumerate(children) for b, m in kids.items()]
        self.steps, self.step_to = Places(np.array([k for k, _ in steps], dtype=np.int64)), np.array([m for _, m in steps], dtype=np.int64)
        self.node_tokens = np.array(tokens, dtype=np.int64)
        own.sort()
        self.n_symbols = np.zeros(self.size + 1, dtype=np.int64)
        self.n_symbols[[i for i, _, _ in own]] = [len(d) for _, d, _ in own]
        self.first_symbol = firsts(self.n_symbols)[:-1]
        data = np.frombuffer(b"".join(d for _, d, _ in own), dtype=np.uint8)
        self.own_symbols = self.inner[data]
        last = firsts([len(d) for _, d, _ in own])[1:][[e for _, _, e in own]] - 1
        self.own_symbols[last] = self.closing[data[last]]
        every = np.arange(self.size)[self.n_symbols[:-1] > 0]
        ids, counts = self.merge_many(self.own_symbols, self.n_symbols[every])
        self.whole = np.zeros(self.size + 1, dtype=bool)
        self.whole[every] = (counts == 1) & (ids[firsts(counts)[:-1]] == every)
        names = [self.tokens.get(i, "") for i in range(self.size)]
        self.as_text = pa.array([(t + " ").encode() for t in names], pa.large_binary())
        self.as_number = pa.array([b"%d " % i for i in range(self.size)], pa.large_binary())

    def symbols(self, word: str) -> list[str]:
        chars = [self.alphabet[b] for b in word.encode()]
        chars[-1] += END
        return chars

    def merge(self, parts: list[str]) -> list[str]:
        """Exact merging, lowest rank first and leftmost among equals: by scans of a short word, for a long one with a heap over a linked list."""
        n = len(parts)
        if n <= 40:
            rank, none = self.rank.get, len(self.rank)
            parts = [*parts]
            ranks = [rank(p, none) for p in zip(parts, parts[1:])]
            while ranks and (least := min(ranks)) < none:
                i = ranks.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
                if i < len(ranks):
                    ranks[i] = rank((parts[i], parts[i + 1]), none)
            return parts
        parts, nxt, prv = [*parts], [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if parts[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], nxt[i] = a + b, "", nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] >= 0 and (r := self.rank.get((parts[x], parts[nxt[x]]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[nxt[x]]))
        return [p for p in parts if p]

    def merged(self, word: str) -> list[int]:
        return [self.vocab[p] for p in self.merge(self.symbols(word)) if p in self.vocab]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.merges.find((a * self.size + b).ravel()).reshape(a.shape)
        off = (a >= self.size) | (b >= self.size)
        return np.where((found < 0) | off, len(self.merged_to), found)

    def merge_many(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many runs of symbols: ids one run after another, and the number of each run's.

        All runs of one length make a step together and are a symbol shorter then; so they join the next shorter ones.
        """
        begin = firsts(counts)[:-1]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(counts > WIDE).tolist():
            names = [self._name(x) for x in symbols[begin[k] : begin[k] + counts[k]].tolist()]
            ids = [self.vocab.get(p, self.size) for p in self.merge(names)]
            done.append((np.array([k]), np.array([ids], dtype=np.int64)))
        order = np.argsort(counts, kind="stable")
        bounds = np.searchsorted(counts[order], np.arange(WIDE + 2))
        rows, syms, ranks, none = np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=np.int64), np.zeros((0, 0), dtype=np.int64), len(self.merged_to)
        for n in range(min(WIDE, int(counts.max(initial=0))), 0, -1):
            new = order[bounds[n] : bounds[n + 1]]
            own = symbols[begin[new][:, None] + np.arange(n)]
            fresh = self._ranks(own[:, :-1], own[:, 1:])
            if len(rows):
                rows, syms, ranks = np.concatenate([rows, new]), np.concatenate([syms, own]), np.concatenate([ranks, fresh])
            else:
                rows, syms, ranks = new, own, fresh
            if n == 1 or not len(rows):
                done.append((rows, syms))
                rows = rows[:0]
                continue
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            go = least < none
            done.append((rows[~go], syms[~go]))
            rows, syms, ranks, at, least = rows[go], syms[go], ranks[go], at[go], least[go]
            every, col = np.arange(len(rows)), np.arange(n - 1)
            syms = np.where(col <= at[:, None], syms[:, :-1], syms[:, 1:])
            syms[every, at] = self.merged_to[least]
            ranks = np.where(col[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            for w, d in ((every[at > 0], 1), (every[at < n - 2], 0)):
                i = at[w] - d
                ranks[w, i] = self._ranks(syms[w, i], syms[w, i + 1])
        out = np.zeros(len(counts), dtype=np.int64)
        for r, m in done:
            out[r] = m.shape[1]
        start = firsts(out)
        ids = np.zeros(start[-1], dtype=np.int64)
        for r, m in done:
            ids[start[r][:, None] + np.arange(m.shape[1])] = m
        return ids, out

    def _name(self, symbol: int) -> str:
        if symbol < self.size:
            return self.tokens[symbol]
        end, b = divmod(symbol - self.size, 256)
        return self.alphabet[b] + END * end

    def greedy(self, word: str) -> list[int] | None:
        """Longest tokens from the left; None where no token fits."""
        text = "".join(self.alphabet[b] for b in word.encode())
        out, i, n = [], 0, len(text)
        vocab, longest = self.vocab, self.longest
        while i < n:
            got = vocab.get(text[i:] + END)
            if got is not None:
                out.append(got)
                return out
            for j in range(min(n - 1, i + longest.get(text[i : i + 2], 1)), i, -1):
                got = vocab.get(text[i:j])
                if got is not None:
                    out.append(got)
                    i = j
                    break
            else:
                return None
        return out

    def proposals(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy cuts of many words: the tokens, and the number of each word's; none where no token fits."""
        word, at, left = np.arange(len(begin)), begin.copy(), np.zeros(len(begin), dtype=bool)
        words, tokens = [], []
        while len(word):
            k, node, p = np.arange(len(word)), np.zeros(len(word), dtype=np.int64), at.copy()
            best, upto = np.full(len(word), -1), at.copy()
            while len(k):
                found = self.steps.find(node * 256 + data[p])
                go = found >= 0
                k, node, p = k[go], self.step_to[found[go]], p[go] + 1
                last = p == end[word[k]]
                token = self.node_tokens[node, last.astype(np.int64)]
                hit = token >= 0
                best[k[hit]], upto[k[hit]] = token[hit], p[hit]
                k, node, p = k[~last], node[~last], p[~last]
            ok = best >= 0
            left[word[~ok]] = True
            word, at = word[ok], upto[ok]
            words.append(word)
            tokens.append(best[ok])
            rest = at < end[word]
            word, at = word[rest], at[rest]
        words, tokens = np.concatenate(words or [np.zeros(0, dtype=np.int64)]), np.concatenate(tokens or [np.zeros(0, dtype=np.int64)])
        if left.any():
            whole = ~left[words]
            words, tokens = words[whole], tokens[whole]
        return tokens[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(begin))

    def _fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair's text, merged, gives the pair."""
        both = np.stack(np.divmod(pairs, self.size), axis=1)
        counts = self.n_symbols[both]
        ids, n = self.merge_many(self.own_symbols[ragged(self.first_symbol[both].ravel(), counts.ravel())], counts.sum(axis=1))
        out = n == 2
        at = firsts(n)[:-1][out]
        out[out] = (ids[at] == both[out, 0]) & (ids[at + 1] == both[out, 1])
        return out

    def _verified(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which words' proposals are what merging gives: one check of all adjacent pairs."""
        good = counts > 0
        single = counts == 1
        start = firsts(counts)
        good[single] = self.whole[ids[start[:-1][single]]]
        at = ragged(start[:-1], np.maximum(counts - 1, 0))
        if not len(at):
            return good
        pairs, which = np.unique(ids[at] * self.size + ids[at + 1], return_inverse=True)
        place = np.searchsorted(self.known, pairs)
        held = place < len(self.known)
        held[held] = self.known[place[held]] == pairs[held]
        fresh = pairs[~held]
        if len(fresh):
            if len(self.known) + len(fresh) > REMEMBERED:
                keep = np.isin(self.known, pairs)
                self.known, self.fits = self.known[keep], self.fits[keep]
            known = np.concatenate([self.known, fresh])
            order = np.argsort(known, kind="stable")
            self.known, self.fits = known[order], np.concatenate([self.fits, self._fit(fresh)])[order]
        bad = ~self.fits[np.searchsorted(self.known, pairs)][which]
        good[np.repeat(np.arange(len(counts)), np.maximum(counts - 1, 0))[bad]] = False
        return good

    def encode_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words (large strings), one after another, and where each word's begin: proposals, their check, exact merging of what fails."""
        data, offsets = bytes_of(words)
        begin, end = offsets[:-1], offsets[1:]
        long = end - begin > WIDE
        ids, counts = self.proposals(data, begin[~long], end[~long])
        if long.any():  # their proposals are put between the others
            cuts = [self.greedy(w.as_py()) or [] for w in words.filter(pa.array(long))]
            own = np.concatenate([np.repeat(np.flatnonzero(~long), counts), np.repeat(np.flatnonzero(long), [len(c) for c in cuts])])
            ids = np.concatenate([ids, np.array([t for c in cuts for t in c], dtype=np.int64)])[np.argsort(own, kind="stable")]
            counts = np.bincount(own, minlength=len(words))
        good = self._verified(ids, counts)
        failed = np.flatnonzero(~good)
        size = (end - begin)[failed]
        at = ragged(begin[failed], size)
        symbols = self.inner[data[at]]
        last = firsts(size)[1:] - 1
        symbols[last] = self.closing[data[at[last]]]
        exact, n_exact = self.merge_many(symbols, size)
        self.all_words += len(words)
        self.exact_words += len(failed)
        total = counts.copy()
        total[failed] = n_exact
        start, out = firsts(total), np.zeros(int(total.sum()), dtype=np.int64)
        keep = np.flatnonzero(good)
        out[ragged(start[keep], counts[keep])] = ids[ragged(firsts(counts)[keep], counts[keep])]
        out[ragged(start[failed], n_exact)] = exact
        if len(exact) and exact.max() >= self.size:  # bytes without a token
            known = out < self.size
            start = firsts(known)[start]
            out = out[known]
        return out, start

    def encode_words(self, new: list[str]) -> list[list[int]]:
        ids, start = self.encode_distinct(pa.array(new, pa.large_string()))
        return [ids[a:b].tolist() for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]

    def normal(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a last sigma is lowered like any other
        return text.lower()

    def _split(self, chunk: str) -> list[str | int]:
        """The words of a text, special tokens as ids."""
        if self.special_split is None or "<" not in chunk:
            return self._plain(self.normal(chunk))
        out: list[str | int] = []
        for k, part in enumerate(self.special_split.split(chunk)):
            out += [self.special[part]] if k % 2 else self._plain(self.normal(part))
        return out

    def _plain(self, text: str) -> list[str]:
        return (self.split if text.isascii() or self.newer_letters.isdisjoint(text) else self.split_newer).findall(text)

    def _cut(self, joined: str, n: int) -> tuple[pa.Array, np.ndarray]:
        """The words of n chunks without white space, given with a line end between two, and the number of each chunk's. A special token is a line end and its id."""
        low = self.normal(joined)
        odd: set[int] = set()
        chunks: list[str] = []
        if any(t in joined for t in self.special) or not low.isascii() and not self.newer_letters.isdisjoint(low):
            chunks = joined.split("\n")
            odd = {k for k, c in enumerate(chunks) if any(t in c for t in self.special) or not self.newer_letters.isdisjoint(self.normal(c))}
        if odd:  # these are cut one by one
            low = self.normal("\n".join("" if k in odd else c for k, c in enumerate(chunks)))
        found = pa.array(self.split_lines.findall(low), pa.large_string())
        ends = np.asarray(pc.equal(found, "\n"), dtype=bool)
        counts = np.diff(np.concatenate([[-1], np.flatnonzero(ends), [len(found)]])) - 1 if n else np.zeros(0, dtype=np.int64)
        found = found.filter(pa.array(~ends))
        if odd:
            where = np.array(sorted(odd))
            own = [[f"\n{w}" if isinstance(w, int) else w for w in self._split(chunks[k])] for k in where.tolist()]
            extra = np.array([len(o) for o in own], dtype=np.int64)
            chunk = np.concatenate([np.repeat(np.arange(n), counts), np.repeat(where, extra)])
            found = pa.concat_arrays([found, pa.array([w for o in own for w in o], pa.large_string())]).take(pa.array(np.argsort(chunk, kind="stable")))
            counts[where] += extra
        return found, counts

    def encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks (large strings without ASCII white space), one after another, and where each chunk's begin."""
        found, counts = self._cut(in_lines(chunks), len(chunks))
        found = found.dictionary_encode()
        words = found.dictionary
        special = np.asarray(pc.starts_with(words, "\n"), dtype=bool)
        ids, start = self.encode_distinct(plain(words.filter(pa.array(~special))))
        if special.any():
            total = np.ones(len(words), dtype=np.int64)
            total[~special] = np.diff(start)
            at = firsts(total)
            out = np.zeros(at[-1], dtype=np.int64)
            out[at[:-1][special]] = [int(w) for w in words.filter(pa.array(special)).to_pylist()]
            out[ragged(at[:-1][~special], total[~special])] = ids
            ids, start = out, at
        return flatten(np.asarray(found.indices, dtype=np.int64), firsts(counts), ids, start)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A code for each chunk between white space, the first code of each text; the ids of all codes, and where each code's begin."""
        codes, first, distinct = coded(texts)
        return codes, first, *self.encode_chunks(distinct)

    def encode(self, text: str | None) -> list[int]:
        return flatten(*self.encode_batch(pa.array([text or ""], pa.large_string())))[0].tolist()

    def decode(self, ids) -> str:
        """The tokens with spaces between them: the vocabulary file names no decoder."""
        return " ".join(self.tokens[int(i)] for i in ids)


@cache
def model(path: str) -> WordBpe:
    """One model for each Python worker."""
    return WordBpe(path)


@cache
def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spelled(values: pa.Array, ids: np.ndarray, start: np.ndarray) -> pa.Array:
    """For each run of ids its values, one after another, as one binary."""
    data = values.take(pa.array(ids))
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int64)[start] if len(data) else np.zeros(len(start), dtype=np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), data.buffers()[2] or pa.py_buffer(b"")])


def hashed(values: pa.Array, codes: np.ndarray, first: np.ndarray) -> pa.Array:
    """SHA-256 of each text's values, one after another without the last byte."""
    data = values.take(pa.array(codes))
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int64)[first].tolist() if len(data) else [0] * len(first)
    raw = memoryview(data.buffers()[2] or b"")
    return pa.array([hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(offsets, offsets[1:])], pa.string())


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path or default_path())
        for batch in batches:
            for part in pieces(batch, "t"):
                codes, first, ids, start = bpe.encode_batch(part.column("t"))
                n = np.diff(firsts(np.diff(start)[codes])[first])
                cols = [part.column("i"), pa.array(n), hashed(spelled(bpe.as_number, ids, start), codes, first), hashed(spelled(bpe.as_text, ids, start), codes, first)]
                yield pa.RecordBatch.from_arrays(cols, names=["i", "n", "a", "d"])

    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {docs.schema[id_col].dataType.simpleString()}, n long, a string, d string")
    return found.select(F.col("i").alias(id_col), F.col("n").alias("n_tokens"), F.col("a").alias("ids_sha256"), F.col("d").alias("decoded_sha256"))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path or default_path())
        for batch in batches:
            for part in pieces(batch, "t"):
                flat, offsets = flatten(*bpe.encode_batch(part.column("t")))
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], names=["i", "ids"])

    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {docs.schema[id_col].dataType.simpleString()}, ids array<int>")
    return found.withColumnRenamed("i", id_col)


def flatten(codes: np.ndarray, first: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and where each text's begin."""
    count = np.diff(start)[codes]
    return ids[ragged(start[codes], count)], firsts(count)[first]


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The table with its ids decoded; null ids give a null text. A column of the table with the new one's name is replaced."""
    from pyspark.sql import types as T

    encoded = encoded.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path or default_path())
        for batch in batches:
            for part in pieces(batch, ids_col, PIECE_BYTES // 8):
                ids = part.column(ids_col).to_pylist()
                yield part.append_column(out_col, pa.array([None if i is None else bpe.decode(i) for i in ids], pa.string()))

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))
