"""Benchmark decontamination by canonical templates and slot consistency."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import U64, code_points, hash_runs, pick, runs, shingles, steps, tidy

#: Template tokens of a window, how many of them must be literal, and the share of an item that tells a leak.
WINDOW = 8
MIN_LITERALS = 4
MIN_COVERAGE = 0.5
#: Items with fewer tokens are matched as whole sentences only, on what stands there.
MIN_TOKENS = 4
#: Literals that an item needs for its whole template to tell a re-parameterised copy.
MIN_WHOLE_LITERALS = 2
#: (text, item) pairs of windows that are expanded at a time.
EXPANDED = 1 << 21
#: Characters of benchmark items that are broadcast at a time; a larger benchmark is matched in several passes.
BLOCK_CHARS = 16 << 20

# Names of units.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces gram grams "
    "kilogram kilograms ton tons ml cl l liter liters litre litres gal gallon gallons s sec secs second seconds min mins "
    "minute minutes h hr hrs hour hours day days week weeks month months year years usd eur gbp dollar dollars cent "
    "cents euro euros pound pounds percent pct degree degrees c f k kmh mph kph hz khz mhz ghz w kw v volt volts a amp "
    "amps j kj cal kcal pa bar byte bytes kb mb gb tb meter meters metre metres kilometer kilometers kilometre kilometres"
).split()

NUMBER, NAME, UNIT = (U64(x) for x in (0x6E756D, 0x6E616D, 0x756E69))
_KINDS: list[np.ndarray] = []
_OTHER, _LETTER, _DIGIT, _ALONE = range(4)
# Code points of scripts that are written without spaces; each sign is a token.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF), (0x20000, 0x323AF),
)
# Signs that end a sentence, in a script with and without spaces, and signs that also set a part off.
STOPS = ".!?:\n。！？："
EDGES = STOPS + ";\"()[]{}<>|/*#\t–—“”„«»‘「」『』（）；"


def _kinds() -> np.ndarray:
    if not _KINDS:
        table = np.zeros(0x110000, dtype=np.uint8)
        upper = np.zeros(0x110000, dtype=bool)
        for code in range(0x110000):
            sign = chr(code)
            if sign.isalpha():
                table[code] = _LETTER
                upper[code] = sign.isupper()
            elif sign.isdigit():
                table[code] = _DIGIT
        for low, high in UNSPACED:
            part = table[low : high + 1]
            part[part == _LETTER] = _ALONE
        _KINDS.extend([table, upper])
    return _KINDS[0]


def _hash_words(items: list[str]) -> np.ndarray:
    codes, at = code_points(items)
    return hash_runs(codes, at[:-1], at[1:] - 1)


@dataclass
class Templates:
    """Canonical tokens of a batch of texts."""

    token: np.ndarray  # hash of the literal, or a placeholder
    value: np.ndarray  # hash of what stands there
    bounds: np.ndarray  # where each text's tokens begin, plus the end
    edge: np.ndarray  # whether a sentence or a part that is set off begins here; one more value for the end


def templates(texts: list[str | None]) -> Templates:
    """Letter and number runs (and single signs of scripts without spaces) with numbers, names and units replaced by typed placeholders.

    A number may hold points, commas, colons or slashes between digits. A unit is a listed word after a number. A name
    is a capitalised word that does not begin a sentence; successive names are one. Other words are case-folded.
    """
    return both_templates(texts)[0]


def both_templates(texts: list[str | None]) -> tuple[Templates, Templates]:
    """The templates, and those in which capitalised words that begin a sentence are names too."""
    table = _kinds()
    codes, at = code_points(texts)
    kinds = table[codes]
    digit = kinds == _DIGIT
    joint = (codes == 46) | (codes == 44) | (codes == 58) | (codes == 47)
    inner = np.zeros(len(codes), dtype=bool)
    if len(codes) > 2:
        inner[1:-1] = joint[1:-1] & digit[:-2] & digit[2:]
    kinds = np.where(inner, _DIGIT, kinds)
    word_begin, word_end = runs(kinds == _LETTER)
    alone = np.flatnonzero(kinds == _ALONE)
    number_begin, number_end = runs(kinds == _DIGIT)
    begin = np.concatenate([word_begin, alone, number_begin])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.concatenate([word_end, alone + 1, number_end])[order]
    number = order >= len(word_begin) + len(alone)
    upper = _KINDS[1][codes]
    folded = np.where(upper & (codes < 0xDF), codes + 32, codes)
    value = hash_runs(folded, begin, end)
    bounds = np.searchsorted(begin, at)
    n = len(begin)
    first = np.zeros(n + 1, dtype=bool)
    first[bounds[:-1]] = True
    first = first[:n]
    # A sentence ends where the gap before a token holds a stop.
    gap = np.concatenate(([0], end[:-1])) if n else np.zeros(0, dtype=np.int64)
    opening, edge = (first | _between(codes, inner, signs, gap, begin) for signs in (STOPS, EDGES))
    capital = upper[begin] & ~number if n else np.zeros(0, dtype=bool)
    shouting = np.zeros(n, dtype=bool)
    many = np.concatenate(([0], np.cumsum(upper)))
    shouting[:] = (many[end] - many[begin] == end - begin) & (end - begin > 1)
    after_number = np.zeros(n, dtype=bool)
    if n > 1:
        after_number[1:] = number[:-1] & ~first[1:] & (begin[1:] - end[:-1] <= 1)
    unit = after_number & ~number & np.isin(value, _hash_words(UNITS))
    proper = capital & ~shouting
    return (
        _placed(value, bounds, number, unit, proper & ~opening, first, edge),
        _placed(value, bounds, number, unit, proper, opening, edge),
    )


def _between(codes: np.ndarray, inner: np.ndarray, signs: str, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether one of the signs stands in codes[low:high], points within numbers apart."""
    found = np.isin(codes, np.array([ord(x) for x in signs], dtype=codes.dtype)) & ~inner
    many = np.concatenate(([0], np.cumsum(found)))
    return many[high] > many[low]


def _placed(
    value: np.ndarray, bounds: np.ndarray, number: np.ndarray, unit: np.ndarray, name: np.ndarray, apart: np.ndarray,
    edge: np.ndarray,
) -> Templates:
    """Templates with these placeholders; successive names are one slot, unless the second is set apart."""
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    # The value of successive names is that of all their words.
    again = np.zeros(len(value), dtype=bool)
    again[1:] = name[1:] & name[:-1] & ~apart[1:]
    keep = np.flatnonzero(~again)
    if len(keep) < len(value):
        value = np.add.reduceat(value, keep)
        bounds = np.searchsorted(keep, bounds)
        token, edge = token[keep], edge[keep]
    return Templates(token, value, bounds, np.append(edge, True))


class Benchmark:
    """The items under both templates; a leak under either counts."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        self.ids = ids
        self.windows = [Windows(made) for made in both_templates(texts)]

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, covered tokens, item tokens, changed slots) for each leaked item of each text.

        The figures are those of the first template under which the item leaks.
        """
        found: set[tuple[int, int]] = set()
        for windows, docs in zip(self.windows, both_templates(texts), strict=True):
            for row in windows.leaks(docs, found):
                found.add(row[:2])
                yield row


@dataclass
class Index:
    """Windows of items in order of their hashes, for a hash join with the windows of documents."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filled: np.ndarray  # which leading bits occur

    BITS = 22

    @classmethod
    def of(cls, tokens: np.ndarray, at: np.ndarray, size: int, item: np.ndarray, place: np.ndarray) -> Index:
        cells = tokens[at[:, None] + np.arange(size)].ravel()
        hashes, _ = shingles(cells, np.arange(len(at) + 1) * size, size)
        order = np.argsort(hashes, kind="stable")
        bits = min(cls.BITS, int(16 * len(hashes)).bit_length())
        filled = np.zeros(1 << bits, dtype=bool)
        filled[(hashes >> U64(64 - bits)).astype(np.int64)] = True
        return cls(hashes[order], item[order], place[order], filled)

    def hits(self, tokens: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Text, place in the text, and range of equal windows, for each window of the texts that the index holds."""
        values, starts = shingles(tokens, bounds, size)
        at = np.flatnonzero(self.filled[(values >> U64(65 - len(self.filled).bit_length())).astype(np.int64)])
        low = np.searchsorted(self.hashes, values[at], side="left")
        high = np.searchsorted(self.hashes, values[at], side="right")
        text = np.searchsorted(starts, at, side="right") - 1
        real = (high > low) & (bounds[text + 1] - bounds[text] >= size)
        at, low, high, text = at[real], low[real], high[real], text[real]
        return text, at - starts[text], low, high


def _expanded(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and value of all values in [low, high) of each row, some at a time."""
    total = np.concatenate(([0], np.cumsum(high - low)))
    first = 0
    while first < len(low):
        last = max(first + 1, int(np.searchsorted(total, total[first] + EXPANDED, side="right")) - 1)
        row = np.repeat(np.arange(first, last), (high - low)[first:last])
        yield row, np.arange(total[last] - total[first]) - np.repeat(total[first:last] - total[first], (high - low)[first:last]) + low[row]
        first = last


class Forms:
    """Items that differ by slot values alone, so that one of them is matched for all.

    Items are alike if their tokens are, and their slots repeat each other at the same places (or hold the same values).
    """

    def __init__(self, made: Templates, items: list[int], by_value: set[int]) -> None:
        self.made = made
        self.first: list[int] = []
        self.members: list[list[int]] = []
        self.values: list[np.ndarray] = []  # members x distinct slots, of each form
        self.order: list[list[tuple[int, int]]] = []  # the distinct slots of the first member
        held: list[list[list[int]]] = []
        place: dict[tuple, int] = {}
        slot = np.isin(made.token, list(SLOTS))
        for item in items:
            own = slice(int(made.bounds[item]), int(made.bounds[item + 1]))
            seen: dict[tuple[int, int], int] = {}
            slots = zip(made.token[own][slot[own]].tolist(), made.value[own][slot[own]].tolist(), strict=True)
            codes = [seen.setdefault(x, len(seen)) for x in slots]
            values = [value for _, value in seen]
            key = (made.token[own].tobytes(), tuple(codes), tuple(values) if item in by_value else ())
            form = place.setdefault(key, len(place))
            if form == len(self.first):
                self.first.append(item)
                self.members.append([])
                held.append([])
                self.order.append(list(seen))
            self.members[form].append(item)
            held[form].append(values)
        self.values = [np.array(x, dtype=U64).reshape(len(x), -1) for x in held]

    def told(self, form: int, chosen: dict[tuple[int, int], int]) -> Iterator[tuple[int, int]]:
        """(item, changed slots) of all members, where `chosen` says what stands for the first member's slots."""
        at = [k for k, slot in enumerate(self.order[form]) if slot in chosen]
        values = np.array([chosen[self.order[form][k]] for k in at], dtype=U64)
        yield from zip(self.members[form], (self.values[form][:, at] != values).sum(axis=1).tolist(), strict=True)


class Windows:
    """The windows of the items' templates, and what is joined whole; all indexes hold forms, not items."""

    def __init__(self, made: Templates) -> None:
        self.made = made
        #: (window size, whether joined on values) -> windows of items of MIN_TOKENS or more
        self.by_size: dict[tuple[int, bool], Index] = {}
        #: (window size, whether joined on values) -> one window of each item that is matched as a whole, and its forms
        self.wholes: dict[tuple[int, bool], tuple[Index, Forms]] = {}
        count = np.diff(made.bounds)
        self.slot = np.isin(made.token, list(SLOTS))
        rows: dict[int, tuple[np.ndarray, ...]] = {}
        weak, by_value = [], set()
        for size in sorted({min(WINDOW, int(n)) for n in count if n >= MIN_TOKENS}):
            own = np.flatnonzero((np.minimum(count, WINDOW) == size) & (count >= MIN_TOKENS))
            item = np.concatenate([np.full(count[i] - size + 1, i) for i in own])
            place = np.concatenate([np.arange(count[i] - size + 1) for i in own])
            at = made.bounds[item] + place
            plain = (~self.slot[at[:, None] + np.arange(size)]).sum(axis=1) >= min(MIN_LITERALS, size - 1)
            rows[size] = item, place, at, plain
            by_value.update(item[~plain].tolist())
            covered = _union(item[plain], place[plain], size, len(count))[own]
            weak += own[covered < MIN_COVERAGE * count[own]].tolist()
        self.forms = Forms(made, [i for i in range(len(count)) if count[i] >= MIN_TOKENS], by_value)
        form_of = np.full(len(count), -1)
        form_of[self.forms.first] = np.arange(len(self.forms.first))
        for size, (item, place, at, plain) in rows.items():
            # Windows that are mostly slots tell nothing by their template, so they are joined on what stands there.
            for exact, good in ((False, plain), (True, ~plain)):
                good = good & (form_of[item] >= 0)
                if good.any():
                    tokens = made.value if exact else made.token
                    self.by_size[size, exact] = Index.of(tokens, at[good], size, form_of[item[good]], place[good])
        # An item whose plain windows cannot tell a copy with other values is matched as a whole, from the window that
        # has most literals on.
        short = [i for i in range(len(count)) if 0 < count[i] < MIN_TOKENS]
        anchors = defaultdict(list)
        for i in weak + [i for i in short if count[i] == MIN_TOKENS - 1]:
            literal = ~self.slot[made.bounds[i] : made.bounds[i + 1]]
            if MIN_WHOLE_LITERALS <= literal.sum() < count[i]:
                anchors[min(WINDOW, int(count[i])), False].append(i)
        for i in short:
            anchors[int(count[i]), True].append(i)
        for (size, exact), items in anchors.items():
            forms, places = Forms(made, items, set(items) if exact else set()), []
            for i in forms.first:
                literal = (~self.slot[made.bounds[i] : made.bounds[i + 1]]).astype(int)
                places.append(int(np.convolve(literal, np.ones(size, dtype=int), "valid").argmax()))
            place = np.array(places, dtype=np.int64)
            at = made.bounds[np.array(forms.first)] + place
            index = Index.of(made.value if exact else made.token, at, size, np.arange(len(place)), place)
            self.wholes[size, exact] = index, forms

    def _aligned(self, docs: Templates) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
        """(text, form) -> (place in the text, place in the item, window size) of equal windows, for the pairs whose
        windows cover enough of the item.

        A window that many forms hold costs a few array cells for each of them; lists are made for the pairs that are
        left alone.
        """
        n_items = len(self.forms.first)
        total = np.diff(self.made.bounds)[self.forms.first]
        joins = [(size, index, index.hits(docs.value if exact else docs.token, docs.bounds, size)) for (size, exact), index in self.by_size.items()]
        parts = []
        for size, index, (text, _, low, high) in joins:
            # Windows that a text repeats count once here.
            _, one = np.unique(text * np.int64(len(index.hashes) + 1) + low, return_index=True)
            for row, at in _expanded(low[one], high[one]):
                parts.append((text[one][row] * n_items + index.item[at], index.place[at], np.full(len(at), size)))
        if not parts:
            return {}
        pair, place, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, number = np.unique(pair, return_inverse=True)
        enough = ids[_union(number, place, size, len(ids)) >= MIN_COVERAGE * total[ids % n_items]]
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for size, index, (text, start, low, high) in joins:
            for row, at in _expanded(low, high):
                pair = text[row] * n_items + index.item[at]
                good = np.flatnonzero(np.isin(pair, enough))
                for t, item, d, i in zip(text[row[good]].tolist(), index.item[at[good]].tolist(), start[row[good]].tolist(), index.place[at[good]].tolist(), strict=True):
                    found[t, item].append((d, i, size))
        return found

    def _whole(self, docs: Templates) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, tokens, changed slots) of items that stand whole between the edges of a sentence."""
        for (size, exact), (index, forms) in self.wholes.items():
            text, start, low, high = index.hits(docs.value if exact else docs.token, docs.bounds, size)
            first = np.array(forms.first)
            for row, at in _expanded(low, high):
                form = index.item[at]
                own = self.made.bounds[first[form]]
                n = self.made.bounds[first[form] + 1] - own
                begin = docs.bounds[text[row]] + start[row] - index.place[at]
                end, last = begin + n, docs.bounds[text[row] + 1]
                fits = (begin >= docs.bounds[text[row]]) & (end <= last)
                fits[fits] = docs.edge[begin[fits]] & (docs.edge[end[fits]] | (end[fits] == last[fits]))
                for k in np.flatnonzero(fits):
                    here, there = slice(int(begin[k]), int(end[k])), slice(int(own[k]), int(own[k] + n[k]))
                    if not (docs.token[here] == self.made.token[there]).all():
                        continue
                    slot = self.slot[there]
                    slots = zip(self.made.token[there][slot].tolist(), self.made.value[there][slot].tolist(), strict=True)
                    chosen = _mapping(list(slots), docs.value[here][slot].tolist())
                    if chosen is not None:
                        yield from ((int(text[row[k]]), item, int(n[k]), changed) for item, changed in forms.told(int(form[k]), chosen))

    def leaks(self, docs: Templates, known: set[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, covered tokens, item tokens, changed slots) for each leaked item of each text, without known ones.

        Equal windows align the tokens of a text with those of an item. A slot value of the item must stand for one
        value wherever an occurrence aligns it; the most frequent one is taken, and windows against it do not count.
        The occurrence that covers most decides. Items that windows cannot tell are looked for as whole sentences.
        """
        told = set(known)
        for (t, form), windows in self._aligned(docs).items():
            if all((t, item) in told for item in self.forms.members[form]):
                continue
            first = self.forms.first[form]
            total = int(self.made.bounds[first + 1] - self.made.bounds[first])
            best, chosen = (0, 0), {}
            for occurrence in _occurrences(windows, total):
                found = self._judge(docs, t, first, occurrence)
                if found[:2] > best:
                    best, chosen = found[:2], found[2]
                if best == (total, 0):
                    break
            if best[0] >= MIN_COVERAGE * total:
                for item, changed in self.forms.told(form, chosen):
                    if (t, item) not in told:
                        told.add((t, item))
                        yield t, item, best[0], total, changed
        least: dict[tuple[int, int], tuple[int, int]] = {}
        for t, item, total, changed in self._whole(docs):
            if (t, item) not in told:
                least[t, item] = min((changed, total), least.get((t, item), (changed, total)))
        for (t, item), (changed, total) in least.items():
            yield t, item, total, total, changed

    def _judge(self, docs: Templates, t: int, item: int, windows: list[tuple[int, int, int]]) -> tuple[int, int, dict]:
        """Tokens of the item that consistent windows of an occurrence cover, the changed slots times -1, and what stands
        for each slot."""
        d0, i0 = int(docs.bounds[t]), int(self.made.bounds[item])
        seen: dict[tuple[int, int], Counter] = defaultdict(Counter)
        pairs = {(d + k, i + k) for d, i, size in windows for k in range(size)}
        for d, i in pairs:
            kind = int(self.made.token[i0 + i])
            if kind in SLOTS:
                seen[kind, int(self.made.value[i0 + i])][int(docs.value[d0 + d])] += 1
        chosen = {slot: min(counts, key=lambda v, c=counts: (-c[v], v)) for slot, counts in seen.items()}

        def fits(d: int, i: int) -> bool:
            kind = int(self.made.token[i0 + i])
            return kind not in SLOTS or chosen[kind, int(self.made.value[i0 + i])] == int(docs.value[d0 + d])

        covered = set()
        for d, i, size in windows:
            if all(fits(d + k, i + k) for k in range(size)):
                covered.update(range(i, i + size))
        return len(covered), -sum(v != slot[1] for slot, v in chosen.items()), chosen


def _union(owner: np.ndarray, place: np.ndarray, size: np.ndarray | int, n: int) -> np.ndarray:
    """For each owner 0..n-1 the number of cells that its stretches [place, place + size) cover; an owner has one size."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    length = np.broadcast_to(size, len(order))[order]
    step = np.where(owner[1:] == owner[:-1], np.minimum(place[1:] - place[:-1], length[:-1]), length[:-1]) if len(order) else order
    return np.bincount(owner, weights=np.append(step, length[-1:]), minlength=n)


def _mapping(item: list[tuple[int, int]], told: list[int]) -> dict[tuple[int, int], int] | None:
    """What stands for each slot, if that is one value for each and at least half as many values remain; else None."""
    mapping: dict[tuple[int, int], int] = {}
    if any(mapping.setdefault(a, b) != b for a, b in zip(item, told, strict=True)) or 2 * len(set(told)) < len(mapping):
        return None
    return mapping


def _occurrences(windows: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows that can belong to one occurrence of an item of `total` tokens.

    An unbroken copy lies on one diagonal (place in the text less place in the item), one with insertions or gaps on
    diagonals within half of the item's length; pieces that are far apart are taken together.
    """
    yield windows
    lanes: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for window in windows:
        lanes[window[0] - window[1]].append(window)
    if len(lanes) == 1:
        return
    yield from lanes.values()
    places, last = sorted(lanes), 0
    for first, lane in enumerate(places):
        begin = last
        while last < len(places) and places[last] - lane <= total // 2:
            last += 1
        if last > max(begin, first + 1):  # not within the stretch before
            yield [window for place in places[first:last] for window in lanes[place]]


SLOTS = frozenset(int(x) for x in (NUMBER, NAME, UNIT))


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of about `block_chars` characters, so that what is broadcast has a bound."""
    rows = pick(benchmark, {id_col: "long", text_col: "string"}).where(F.col(text_col).isNotNull())
    total = rows.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_chars))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)) == k) if blocks > 1 else rows
        got = part.orderBy(id_col, text_col).collect()
        yield Benchmark([r[0] for r in got], [r[1] for r in got])


def _matcher(shared):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark: Benchmark = shared.value
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for first, last in steps(texts):
                rows += [(first + t, *rest) for t, *rest in benchmark.leaks(texts[first:last])]
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[r[0]] for r in rows], pa.int64()),
                    "item_id": pa.array([benchmark.ids[r[1]] for r in rows], pa.int64()),
                    "matched_tokens": pa.array([r[2] for r in rows], pa.int64()),
                    "item_tokens": pa.array([r[3] for r in rows], pa.int64()),
                    "changed_slots": pa.array([r[4] for r in rows], pa.int64()),
                }
            )

    return match


def _cleaner(shared, text_index: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark: Benchmark = shared.value
        for batch in batches:
            texts, keep = batch.column(text_index).to_pylist(), np.ones(batch.num_rows, dtype=bool)
            for first, last in steps(texts):
                for t, *_ in benchmark.leaks(texts[first:last]):
                    keep[first + t] = False
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return clean


def leaked_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The benchmark items that each row leaks: doc_id, item_id, matched_tokens, item_tokens, changed_slots.

    Numbers, units and names become typed placeholders on both sides (each sign of a script without spaces is a token); windows of template tokens are joined by hash, and
    windows of too few literal tokens by a hash of the original values, so that such parts are found where unchanged;
    an item is leaked if consistent windows of one occurrence, or of the whole text, cover at least half of its tokens.
    A text that holds an item several times is judged by the occurrence that covers most. An item of fewer than four
    tokens, which has no windows, leaks where it stands word for word as a sentence or a part that is set off; one whose
    windows are mostly slots leaks also where its whole template, of two literals or more, stands so with slots that are
    changed alike. Capitalised words that begin a
    sentence are literal in a first template and names in a second one; a leak under either counts. changed_slots counts slot values that
    differ from the item's: 0 for a leak that begins a sentence as the item does, more for a re-parameterised one (or
    where the word before joins a name at the item's beginning).

    Defined cases: null or empty texts leak nothing; items that are null or have no token are not matched; repeated documents and repeated items give a row each; null ids are passed on; an empty table on either
    side gives no rows; further columns are ignored; texts of any length are matched whole.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = pick(docs, {id_col: "long", text_col: "string"})
    schema = "doc_id long, item_id long, matched_tokens long, item_tokens long, changed_slots long"
    out = None
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_chars):
        part = rows.mapInArrow(tidy(_matcher(spark.sparkContext.broadcast(block))), schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of `docs` that leak no benchmark item, with all their columns; the rules are those of leaked_items."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text_col)
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_chars):
        docs = docs.mapInArrow(tidy(_cleaner(spark.sparkContext.broadcast(block), at)), docs.schema)
    return docs
