"""Detection of source lines and search among few references, for one string in a worker.

What these classes hold is bounded (retrieval.are_few and FORMS, FORM_CHARS): the operators use them where references and forms
are few, and joins otherwise.  Bounds decide what is compared as strings; what they rule out can't be the best or be accepted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from decimal import ROUND_HALF_EVEN, Decimal
from difflib import SequenceMatcher
from math import log

import numpy as np

from paragram.functions import plain

#: Entries of a worker's small caches.
CACHED = 10_000
_NINTH = Decimal("1e-9")


def nine(x: float) -> float:
    """bround(x, 9)."""
    return float(Decimal(repr(float(x))).quantize(_NINTH, ROUND_HALF_EVEN))


def remembered(cache: dict, key, make):
    if key not in cache:
        if len(cache) >= CACHED:
            cache.clear()
        cache[key] = make()
    return cache[key]


class Detector:
    """surface_scores of one line."""

    def __init__(self, p, starters: Iterable[str], frequent: Iterable[str], lengths: tuple[int | None, int | None], forms: Iterable[str]):
        self.p, self.starters, self.frequent, self.lengths, self.forms = p, frozenset(starters), frozenset(frequent), lengths, frozenset(forms)

    def __call__(self, line: str) -> tuple[int, float, int] | None:
        """n_tokens, coverage, score; None without tokens."""
        p, tokens = self.p, plain.tokens(line)
        if not tokens:
            return None
        n, forms = len(tokens), self.forms
        hits = sum(any(v in forms for v in plain.variants(t)) for t in tokens) if p.variants else sum(t in forms for t in tokens)
        coverage, hyphens = hits / n, sum("-" in t for t in tokens)
        score = 2 if (hyphens / n >= p.hyphen_share if p.hyphen_share is not None else hyphens > 0) else 0
        score += 2 * (coverage >= p.coverage[0]) + sum(coverage >= c for c in p.coverage[1:])
        low, high = self.lengths
        if low is not None and high is not None:
            score += low <= n <= (min(high, p.longest) if p.longest else high)
        score += tokens[0] in self.starters
        if p.frequent_ahead:
            score += any(t in self.frequent for t in tokens[: p.frequent_ahead])
        if p.english_penalty and plain.english_score(line) > 0.20:
            score -= 2
        return n, coverage, int(score)


class Inside:
    """Whether one of a few references contains a line, as they are or both without hyphens."""

    GRAM = 6

    def __init__(self, refs: list[str]):
        self.refs = [refs, [r.replace("-", "") for r in refs]]
        self.grams: list[set[str]] | None = None
        self.short: dict[str, bool] = {}

    def _within(self, line: str, k: int) -> bool:
        if len(line) >= self.GRAM:
            return line[: self.GRAM] in self.grams[k] and any(line in r for r in self.refs[k])
        return remembered(self.short, (line, k), lambda: any(line in r for r in self.refs[k]))

    def __call__(self, line: str | None) -> bool:
        if not line:
            return False
        if self.grams is None:  # built where it is used
            self.grams = [{r[i : i + self.GRAM] for r in refs for i in range(len(r) - self.GRAM + 1)} for refs in self.refs]
        return self._within(line, 0) or self._within(line.replace("-", ""), 1)


def masks(text: str) -> dict[str, bytes]:
    """Of each sign the places in a text as bits, and under '' all places; at least one bit above them is free."""
    out = {"": (1 << len(text)) - 1}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    n = len(text) // 8 + 1
    return {c: m.to_bytes(n, "little") for c, m in out.items()}


def common(a: str, known: list[dict[str, bytes]]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each of the texts given by their masks.

    Bit-parallel, all texts side by side in one integer; a carry ends in the free bit above its text.  The blocks that
    SequenceMatcher adds up are one common subsequence, so they aren't longer together.
    """
    none = [bytes(len(m[""])) for m in known]
    joined = lambda c: int.from_bytes(b"".join([m.get(c, z) for m, z in zip(known, none, strict=True)]), "little")
    at, full = {c: joined(c) for c in set(a)}, joined("")
    v = full
    for c in a:
        u = v & at[c]
        if u:
            v = (v + u | v - u) & full
    sizes = np.array([len(z) for z in none])
    starts = np.cumsum(sizes) - sizes
    bits = np.unpackbits(np.frombuffer((v ^ full).to_bytes(int(sizes.sum()), "little"), np.uint8).reshape(-1, 1), axis=1).sum(axis=1, dtype=np.int64)
    return np.add.reduceat(bits, starts)


def best_of_shortlist(text: str | None, texts: list[str], base: list[float], more: list[float]) -> list[tuple[int, float]]:
    """Place and score base + .35 * ratio + more of the best of a few texts; of equal scores (nine digits) the first."""
    if text is None:
        return []
    known = common(text, [masks(b) for b in texts])
    upper = [x + 0.35 * (2.0 * int(c) / (len(text) + len(b)) if text or b else 1.0) + y for x, y, b, c in zip(base, more, texts, known, strict=True)]
    found, top = [], 0.0
    for i in sorted(range(len(texts)), key=lambda i: -upper[i]):
        if upper[i] < top - 2e-9:
            break
        score = base[i] + 0.35 * SequenceMatcher(None, text, texts[i]).ratio() + more[i]
        found.append((-nine(score), i, score))
        top = max(top, score)
    _, i, score = min(found)
    return [(i, score)]


class Strings:
    """Similarity to a fixed list of strings, with an upper bound of all at once."""

    BUCKETS = 64

    def __init__(self, texts: list[str]):
        self.texts, self.length = texts, np.array([len(t) for t in texts], np.int64)
        self.signs = np.stack([self._signs(t) for t in texts]) if texts else np.zeros((0, self.BUCKETS), np.int32)
        self.matchers: dict[str, SequenceMatcher] = {}
        self.masks: dict[int, dict[str, bytes]] = {}

    def _signs(self, text: str) -> np.ndarray:
        out = np.zeros(self.BUCKETS, np.int32)
        for c, n in Counter(text).items():
            out[ord(c) % self.BUCKETS] += n
        return out

    def bound(self, text: str, at: np.ndarray) -> np.ndarray:
        """No ratio with the strings at these places is greater: by the signs that both have."""
        total = self.length[at] + len(text)
        common = np.minimum(self.signs[at], self._signs(text)).sum(axis=1)
        return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)

    def close_bound(self, text: str, at: np.ndarray) -> np.ndarray:
        """No ratio with the strings at these places is greater: by the longest common subsequences."""
        parts = [np.zeros(0)]
        for i in range(0, len(at), 512):
            known = [remembered(self.masks, int(k), lambda k=k: masks(self.texts[k])) for k in at[i : i + 512]]
            total = self.length[at[i : i + 512]] + len(text)
            parts.append(np.where(total > 0, 2.0 * common(text, known) / np.maximum(total, 1), 1.0))
        return np.concatenate(parts)

    def ratio(self, text: str, i: int) -> float:
        """As SequenceMatcher(None, text, texts[i]).ratio()."""
        b = self.texts[i]
        m = self.matchers.get(b)
        if m is None:
            if len(self.matchers) >= CACHED:
                self.matchers.clear()
            m = self.matchers[b] = SequenceMatcher(None, "", b)
        m.set_seq1(text)
        return m.ratio()


class Blended:
    """weight of string similarity and 1 - weight of the token sets' similarity, over a pool of strings."""

    def __init__(self, texts: list[str], tokens: list[list[str]], weight: float):
        self.strings, self.weight, self.sets = Strings(texts), weight, [frozenset(t) for t in tokens]
        self.kinds = np.array([len(s) for s in self.sets], np.int64)
        at: dict[str, list[int]] = {}
        for i, s in enumerate(self.sets):
            for t in s:
                at.setdefault(t, []).append(i)
        self.postings = {t: np.array(v) for t, v in at.items()}

    def best(self, text: str, tokens: list[str], pool: np.ndarray, least: float) -> tuple[float, int] | None:
        """score, place in texts; of equal scores (nine digits) the first of the pool; None where no score reaches `least`."""
        own, shared = set(tokens), np.zeros(len(self.kinds), np.int64)
        for t in own:
            if t in self.postings:
                shared[self.postings[t]] += 1
        shared = shared[pool]
        # max: an empty set's similarity is 0
        alike = shared / np.maximum(len(own) + self.kinds[pool] - shared, 1)
        w = self.weight
        place = np.flatnonzero(w * 2.0 * np.minimum(self.strings.length[pool], len(text)) / np.maximum(self.strings.length[pool] + len(text), 1) + (1 - w) * alike >= least - 1e-9)
        if not len(place):
            return None
        place = place[w * self.strings.bound(text, pool[place]) + (1 - w) * alike[place] >= least - 1e-9]
        upper = w * self.strings.close_bound(text, pool[place]) + (1 - w) * alike[place]
        found, top = None, 0.0
        for j in np.argsort(-upper, kind="stable"):
            if upper[j] < max(least, top) - 2e-9:
                break
            at = int(place[j])
            score = w * self.strings.ratio(text, int(pool[at])) + (1 - w) * float(alike[at])
            rank = (-nine(score), at)
            if found is None or rank < found[0]:
                found, top = (rank, score, int(pool[at])), max(top, score)
        return found[1:] if found and found[1] >= least else None


class WholeReferences:
    """best_reference: references with the same first token and the first ones, the closest by token count."""

    def __init__(self, refs: list[tuple[int, str]], accept: float, weight: float = 0.65, first: int = 2000, most: int = 300):
        refs = sorted((i, r) for i, r in refs if r)
        self.most, self.accept, tokens = most, accept, [plain.tokens(r) for _, r in refs]
        self.size, self.begins = np.array([len(t) for t in tokens], np.int64), np.array([t[0] if t else "" for t in tokens])
        self.ahead = np.array([at for at, (i, _) in enumerate(refs) if i < first], np.int64)
        self.blended, self.pools = Blended([r for _, r in refs], tokens, weight), {}

    def _pool(self, k: int, ft: str) -> np.ndarray:
        same = np.flatnonzero(self.begins == ft)
        at, src = np.concatenate([same, self.ahead]), np.repeat([0, 1], [len(same), len(self.ahead)])
        return at[np.lexsort((at, src, np.abs(k - self.size[at])))][: self.most]

    def __call__(self, cand: str, aliases: tuple[int, ...]):
        tokens = plain.tokens(cand)
        if not tokens:
            return None
        found = self.blended.best(cand, tokens, remembered(self.pools, (len(tokens), tokens[0]), lambda: self._pool(len(tokens), tokens[0])), self.accept)
        return found and (found[0], self.blended.strings.texts[found[1]], 0, 0.0)


class SingleLines:
    """best_reference_line: lines of the aliases on the page, those with the same first token, the first ones."""

    def __init__(self, refs: list[tuple[int, str]], aliases: list[list[tuple[int, int]]], accept: float, weight: float = 0.55, first: int = 3000, most: int = 500, gap: int = 18, least: float = 0.46):
        """aliases: of each alias, in the order of their numbers, (ref, pos) where it stands."""
        self.accept, self.most, self.gap, self.least = accept, most, gap, least
        lines = [(ref * 1_000_000 + pos, ref, line) for ref, text in refs for pos, line in enumerate(plain.units(text, plain.clean_marks))]
        at: dict[str, int] = {}
        for n, _, line in sorted(lines):
            at.setdefault(line, n)
        texts = sorted(at, key=at.get)
        self.tokens = [plain.tokens(t, plain.clean_marks) for t in texts]
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        number = {t: i for i, t in enumerate(texts)}
        self.blended, self.same, self.pools = Blended(texts, self.tokens, weight), {}, {}
        for i, t in enumerate(self.tokens):
            if t:
                self.same.setdefault(t[0], []).append(i)
        worded = [line for _, _, line in sorted(lines) if self.tokens[number[line]]]
        self.ahead = np.array(sorted({number[line] for line in worded[:first]}), np.int64)
        of_ref: dict[int, list[tuple[int, int]]] = {}
        for n, ref, line in lines:
            of_ref.setdefault(ref, []).append((n, number[line]))
        self.listed = []
        for where in aliases:
            where = [w for w in where if w[0] in of_ref]
            place, first_at = min(where, default=None), {}
            for ref in {r for r, _ in where}:
                for n, i in of_ref[ref]:
                    first_at[i] = min(n, first_at.get(i, n))
            self.listed.append([(place, n, i) for i, n in first_at.items()])

    def _pool(self, aliases: tuple[int, ...], k: int, ft: str) -> np.ndarray:
        spots: dict[int, tuple] = {}
        for a in aliases:
            for place, n, i in self.listed[a]:
                spots[i] = min((place, n), spots.get(i, (place, n)))
        pool = np.concatenate([np.array(x, np.int64) for x in (sorted(spots, key=spots.get), self.same.get(ft, ()), self.ahead)])
        pool = pool[np.abs(self.size[pool] - k) <= self.gap]
        return pool[np.sort(np.unique(pool, return_index=True)[1])][: self.most]

    def __call__(self, cand: str, aliases: tuple[int, ...]):
        tokens = plain.tokens(cand, plain.clean_marks)
        if not tokens:
            return None
        least = min(self.least, self.accept) if aliases else self.accept
        pool = remembered(self.pools, (aliases, len(tokens), tokens[0]), lambda: self._pool(aliases, len(tokens), tokens[0]))
        found = self.blended.best(cand, tokens, pool, least)
        return found and (found[0], self.blended.strings.texts[found[1]], 0, 0.0)


class Windows:
    """Retrieval and reranking among windows of 1 to 3 units, all of those that share a token: no postings, pool or shortlist is cut."""

    def __init__(self, refs: list[tuple[int, str]], aliases: list[list[tuple[int, int]]], least: int = 2, most: int = 35):
        self.refs_of = [frozenset(r for r, _ in where) for where in aliases]
        rows = []
        for ref, text in refs:
            units = [u for u in plain.units(text, plain.signs) if least <= len(plain.tokens(u)) <= most]
            for k in (1, 2, 3):
                for start in range(len(units) - k + 1):
                    window = " ".join(units[start : start + k])
                    tokens = plain.tokens(window)
                    if len(set(tokens)) >= 2:
                        rows.append((ref * 4_000_000 + k * 1_000_000 + start, ref, window, tokens, frozenset(tokens)))
        self.rows = sorted(rows, key=lambda r: r[0])
        at: dict[str, list[int]] = {}
        for i, r in enumerate(self.rows):
            for t in r[4]:
                at.setdefault(t, []).append(i)
        self.postings = {t: np.array(v) for t, v in at.items()}
        self.idf = {t: log((1 + len(self.rows)) / (1 + len(v))) + 1 for t, v in at.items()}
        self.weight = np.array([sum(self.idf[t] for t in sorted(r[4])) for r in self.rows])
        self.strings, self.begins = Strings([plain.canonical(r[2]) for r in self.rows]), {}
        for i, r in enumerate(self.rows):
            self.begins.setdefault(tuple(r[3][:2]), []).append(i)

    def _retrieval(self, i: int, tokens: list[str], aliases: tuple[int, ...]) -> float:
        _, ref, _, _, own = self.rows[i]
        score = sum(self.idf[v] for v in sorted({v for t in tokens for v in plain.variants(t)} & own))
        return score + (5.0 if any(ref in self.refs_of[a] for a in aliases) else 0.0)

    def __call__(self, cand: str, aliases: tuple[int, ...]):
        tokens, alias = plain.tokens(cand), bool(aliases)
        n = len(self.rows)
        overlap, shared, weight = np.zeros(n), np.zeros(n, np.int64), 0.0
        for t in sorted(set(tokens)):
            weight += self.idf.get(t, 1.0)
            if t in self.postings:
                overlap[self.postings[t]] += self.idf[t]
                shared[self.postings[t]] += 1
        coarse = overlap / np.maximum(weight + self.weight - overlap, 1e-300)
        coarse[self.begins.get(tuple(tokens[:2]), [])] += 0.05
        coarse += 0.04 if alias else 0.0
        bonus, least = (0.05, 0.34) if alias else (0.0, 0.40)  # nothing below is accepted
        at = np.flatnonzero((shared > 0) & (0.65 * coarse + 0.35 + bonus >= least - 1e-9))
        if not len(at):
            return None
        text = plain.canonical(cand)
        at = at[0.65 * coarse[at] + 0.35 * self.strings.bound(text, at) + bonus >= least - 1e-9]
        upper = 0.65 * coarse[at] + 0.35 * self.strings.close_bound(text, at) + bonus
        found, top, ratios = [], 0.0, {}
        for j in np.argsort(-upper, kind="stable"):
            if upper[j] < max(least, top) - 2e-9:
                break
            i = int(at[j])
            b = self.strings.texts[i]
            if b not in ratios:
                ratios[b] = self.strings.ratio(text, i)
            final = 0.65 * float(coarse[i]) + 0.35 * ratios[b] + bonus
            top = max(top, final)
            found.append(((-nine(final), -nine(coarse[i])), i, final))
        if not found:
            return None
        rank = min(f[0] for f in found)
        ties = [(i, final) for r, i, final in found if r == rank]
        i, final = ties[0] if len(ties) == 1 else min(ties, key=lambda x: (-nine(self._retrieval(x[0], tokens, aliases)), self.rows[x[0]][0]))
        s = int(shared[i])
        if (final >= 0.40 and s >= 3) or (final >= 0.47 and s >= 2) or (alias and final >= 0.34 and s >= 2):
            return final, self.rows[i][2], s, float(overlap[i])
        return None


class Miner:
    """Pairs of a page (lines and flags of source lines): src, tgt, line_no, score, distance, reference_score, shared, overlap, reference, alias_match, translation_score."""

    def __init__(self, p, detector: Detector, least: int, accept: int, make, *args):
        """make(*args): the search, built where it is used."""
        self.p, self.detector, self.least, self.accept, self.make, self.args = p, detector, least, accept, make, args
        self.hyphened, self.search, self.sources, self.answers = frozenset(f for f in detector.forms if "-" in f), None, {}, {}

    def _source(self, line: str):
        """cand, n_tokens, coverage of a source line; None for one that isn't."""
        cand = " ".join(plain.rejoined([w for w in plain.signs(line).split(" ") if w], self.hyphened))
        found = self.detector(cand) if cand else None
        return (cand, *found[:2]) if found and found[2] >= self.least else None

    def __call__(self, lines: list[str] | None, flags: list[bool | None], aliases: list[int]) -> list[tuple]:
        if not lines:
            return []
        self.search = self.search or self.make(*self.args)
        aliases, english, out = tuple(aliases), {}, []
        for i, (line, flag) in enumerate(zip(lines, flags, strict=True)):
            source = remembered(self.sources, line, lambda x=line: self._source(x)) if flag else None
            if source is None:
                continue
            near = self._near(lines, i, english)
            if near is None:
                continue
            cand, n_tokens, coverage = source
            best = remembered(self.answers, (cand, aliases), lambda c=cand: self.search(c, aliases))
            if best is not None:
                row = self._row(cand, n_tokens, coverage, i, best, lines[near[0]], abs(near[0] - i), near[1], bool(aliases))
                if row is not None:
                    out.append(row)
        return out

    def _near(self, lines: list[str], i: int, english: dict[int, bool]) -> tuple[int, float] | None:
        best = None
        for b in range(max(0, i - self.p.window), min(len(lines), i + self.p.window + 1)):
            if b == i:
                continue
            if b not in english:
                english[b] = plain.sentence_and_english(lines[b], self.p.name)
            if english[b]:
                d = abs(b - i)
                score = plain.english_score(lines[b]) + 0.04 * max(0, 6 - d) if self.p.name == "v32" else -float(d)
                if best is None or score > best[1]:
                    best = (b, score)
        return best

    def _row(self, cand, n_tokens, coverage, i, best, tgt, distance, near, alias):
        name, (reference_score, reference, shared, overlap) = self.p.name, best
        score = (5 if alias else 0) + 3 + 2 + (2 if distance <= (3 if name == "v3" else 4) else 1 if name == "v32" else 0)
        if name == "v32":
            score += (shared >= 3) + (coverage >= 0.5)
        else:
            score += 3 <= n_tokens <= (40 if name == "v3" else 45) and 3 <= len(tgt.split()) <= (50 if name == "v3" else 55)
        src, tgt = cand.lower().strip(), tgt.lower().strip()
        if score < self.accept or not (5 <= len(src) <= 500 and 5 <= len(tgt) <= 500):
            return None
        return src, tgt, i, int(score), distance, reference_score, shared, overlap, reference, alias, near
