"""Distinct sampled segmentations of a text into vocabulary pieces, and their decoding.

All segmentations of a text are the paths of its lattice; a path's probability is in proportion
to the product of its pieces' weights, which fall with a piece's number in the vocabulary (the
model's files carry merge ranks, not probabilities). Gumbel noise, given to whole paths,
orders them; the k highest are a sample without replacement. They are found by an A-star search
from the start: a search node is a set of paths with a common beginning, its priority the
exact maximum of its paths' perturbed scores, which is drawn top-down, truncated at the parent's.
The set's most likely way on keeps the parent's value, so a popped node runs to the end of the
text at once, for all texts of a slice together; what branches off at each step goes to the
frontier as one set with one truncated value and is only parted when popped.

Texts are cut where no piece goes across, so that a lattice belongs to a short run of characters; a worker
keeps the lattices of the runs that it has met, up to a bound beyond which it forgets those seldom met. Logarithms are sums of whole multiples of
``UNIT``, so that no result depends on which texts are worked on together.

Noise is a hash of the row's key, the path's number and the character position, so a row's samples depend
on nothing else. A null or empty text has one segmentation, of no pieces. A text with fewer
segmentations than k gives them all, with inclusion 1 (log 0). Very long texts are worked on whole.
Rows that repeat get the same samples, an empty table gives no row, null keys are a key like any other, and further
columns of ``docs`` are not read, whatever their names. A literal U+2581 in a text decodes as a space.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Grown, arrow_map, mix, ragged, remember, slices, with_fields
from larkspur.llm.langid import levels
from larkspur.llm.pieces import SPACE, vocabulary

#: A piece's weight is 1 / (its number + OFFSET) to the power SHARPNESS; a byte's is BYTE.
OFFSET, SHARPNESS, BYTE = 10, 1.0, 1e-6
#: Logarithms of probabilities are whole multiples of this.
UNIT = 2.0**-36
#: A slice of texts is smaller here: their paths are held as well.
CHARS = 200_000
#: Once a worker's lattices have so many edges, it forgets those that were least often met again, and keeps this part of the edges at most.
MOST_EDGES, KEPT = 1_200_000, 0.6

COLUMNS = "sample int, n_pieces int, log_prob double, perturbed double, log_inclusion double, decodes boolean, ids array<int>"


def uniform(seed: np.ndarray, path: int, position: np.ndarray, use: int) -> np.ndarray:
    """Numbers in (0, 1)."""
    x = seed.astype(np.uint64) + mix(position.astype(np.uint64) * np.uint64(8) + np.uint64(use)) + np.uint64((path * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def same_ranges(got: np.ndarray, at: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """Whether each range of ``got``, which begin and at last end at ``at``, holds the bytes wanted."""
    same = np.diff(at) == np.fromiter(map(len, wanted), np.int64, len(wanted))
    if same.all():
        wrong = np.r_[0, np.cumsum(got != np.frombuffer(b"".join(wanted), np.uint8))]
        return wrong[at[1:]] == wrong[at[:-1]]
    for i in np.flatnonzero(same).tolist():
        same[i] = got[at[i] : at[i + 1]].tobytes() == wanted[i]
    return same


class Bank:
    """The lattices of all runs of characters met so far, with each edge's probability given its first node."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.clear()
        remember(self)

    def clear(self) -> None:
        self.index: defaultdict = defaultdict(itertools.count().__next__)
        self.known = 0
        # by run: its first and last node, and how often it was met again, of late above all; by node: its first edge and their number
        self.first, self.last, self.again, self.begin, self.degree = (Grown(np.int32) for _ in range(5))
        # by edge: the node it leads to, log probability in units, the node's probability up to here, first id and their number
        self.target, self.log, self.upto = Grown(np.int32), Grown(np.int64), Grown(np.float64)
        self.id_at, self.n_ids, self.ids = Grown(np.int32), Grown(np.uint8), Grown(np.int32)

    def codes(self, text: str, starts: np.ndarray) -> np.ndarray:
        """A number for each run of ``text``, which begin at ``starts``; new ones are learned. Runs are known by 64-bit hashes."""
        if len(self.target) > MOST_EDGES:
            self.forget()
        if not len(starts):
            return np.zeros(0, np.int64)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.diff(starts, append=len(chars))
        place = np.arange(len(chars)) - np.repeat(starts, sizes)
        hashes = np.add.reduceat(mix(place.astype(np.uint64) << np.uint64(21) | chars), starts)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        numbers = np.fromiter(map(self.index.__getitem__, distinct.tolist()), np.int64, len(distinct))
        self.again.now[numbers[numbers < self.known]] += 1
        if len(self.index) > self.known:
            new = np.flatnonzero(numbers >= self.known)
            new = at[new[np.argsort(numbers[new])]]
            self.learn([text[a : a + n] for a, n in zip(starts[new].tolist(), sizes[new].tolist())])
            self.known = len(self.index)
        return numbers[which]

    def forget(self) -> None:
        """Keeps the runs that were met again most often; all others go, and those that were not met again."""
        first, last = self.first.now.astype(np.int64), self.last.now.astype(np.int64)
        edge = self.begin.now[first].astype(np.int64)
        n_edges = self.begin.now[last] - edge
        often = np.argsort(-self.again.now, kind="stable")
        kept = np.sort(often[(np.cumsum(n_edges[often]) <= KEPT * MOST_EDGES) & (self.again.now[often] > 0)])
        names = list(self.index)
        self.index = defaultdict(itertools.count(len(kept)).__next__, zip(map(names.__getitem__, kept.tolist()), range(len(kept))))
        self.known = len(kept)
        first, edge, n_nodes, n_edges = first[kept], edge[kept], (last - first + 1)[kept], n_edges[kept]
        ids = self.id_at.now[edge].astype(np.int64)
        at_end = edge + n_edges - 1
        n_ids = self.id_at.now[at_end] + self.n_ids.now[at_end] - ids
        starts = lambda n: np.cumsum(n) - n
        to_node, to_edge, to_id = starts(n_nodes) - first, starts(n_edges) - edge, starts(n_ids) - ids  # how far each run's move
        self.again.take(kept, self.again.now[kept] >> 1)
        self.first.take(kept, first + to_node), self.last.take(kept, last[kept] + to_node)
        nodes, edges = ragged(first, n_nodes), ragged(edge, n_edges)
        self.begin.take(nodes, self.begin.now[nodes] + np.repeat(to_edge, n_nodes)), self.degree.take(nodes)
        self.target.take(edges, self.target.now[edges] + np.repeat(to_node, n_edges))
        self.id_at.take(edges, self.id_at.now[edges] + np.repeat(to_id, n_edges))
        for x in (self.log, self.upto, self.n_ids):
            x.take(edges)
        self.ids.take(ragged(ids, n_ids))

    def learn(self, runs: list[str]) -> None:
        x = self.vocab.lattice(runs)
        last = x.first + x.length
        begin = x.begins()
        plain = x.piece >= 0
        weight = np.where(plain, -SHARPNESS * np.log(np.maximum(x.piece, 0) + float(OFFSET)), np.log(BYTE) * -np.minimum(x.piece, 0))
        beta = np.full(len(begin), -np.inf)
        beta[last] = 0.0
        order, ranges = levels(x, x.source)
        for a, b in reversed(ranges):
            edges = order[a:b]
            nodes = x.source[edges]
            starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
            value = weight[edges] + beta[x.target[edges]]
            top = np.maximum.reduceat(value, starts)
            sizes = np.diff(np.r_[starts, len(edges)])
            beta[nodes[starts]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, sizes)), starts))
        log = np.round(np.minimum(weight + beta[x.target] - beta[x.source], 0.0) / UNIT).astype(np.int64)
        share = np.exp(log * UNIT)
        total = np.r_[0.0, np.cumsum(share)]
        low = total[begin[x.source]]
        n_ids = np.where(plain, 1, -x.piece)
        id_at = np.cumsum(n_ids) - n_ids
        ids = np.empty(int(n_ids.sum()), np.int32)
        ids[id_at[plain]] = x.piece[plain]
        for e in np.flatnonzero(~plain).tolist():
            run = int(np.searchsorted(x.first, x.source[e], "right")) - 1
            ids[id_at[e] : id_at[e] + n_ids[e]] = self.vocab.bytes_of(runs[run][x.source[e] - x.first[run]])
        nodes, edges = len(self.begin), len(self.target)
        self.first.add(x.first + nodes), self.last.add(last + nodes), self.again.add(np.zeros(len(runs), np.int32))
        self.begin.add(begin[:-1] + edges), self.degree.add(np.diff(begin))
        self.target.add(x.target + nodes), self.log.add(log)
        # a node's shares sum to 1 but for rounding
        self.upto.add((total[1:] - low) / (total[begin[x.source + 1]] - low))
        self.id_at.add(id_at + len(self.ids)), self.n_ids.add(n_ids), self.ids.add(ids)

    def rest(self, edge: np.ndarray) -> np.ndarray:
        """The log probability of what else leaves each edge's node."""
        with np.errstate(divide="ignore"):
            return np.log1p(-np.exp(self.log.now[edge] * UNIT))

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node: the first whose probability, with those before it, reaches ``u``."""
        low, upto = self.begin.now[node], self.upto.now
        high = low + self.degree.now[node] - 1
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            below = upto[middle] < u
            low = np.where(below, np.minimum(middle + 1, high), low)
            high = np.where(below, high, middle)
        return low

    def walk(self, node: np.ndarray, last: np.ndarray, seed: np.ndarray, position: np.ndarray, path: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges from each start node to its run's end, drawn by probability; their positions; their number by start)."""
        n = np.zeros(len(node), np.int64)
        steps, target = [], self.target.now
        live = np.flatnonzero(node < last)
        node, last, seed, position = node[live], last[live], seed[live], position[live]
        while len(live):
            edge = self.choose(node, uniform(seed, path, position, 0))
            steps.append((live, edge, position))
            n[live] += 1
            after = target[edge]
            position = position + (after - node)
            on = after < last
            live, node, last, seed, position = live[on], after[on], last[on], seed[on], position[on]
        edges, at, base = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64), np.cumsum(n) - n
        for i, (who, edge, where) in enumerate(steps):
            place = base[who] + i
            edges[place], at[place] = edge, where
        return edges, at, n


@dataclass
class Found:
    """One path of each text of ``texts``, laid end to end: from begin[i] to begin[i + 1] that of texts[i]."""

    texts: np.ndarray
    begin: np.ndarray
    value: np.ndarray  # by text, the path's perturbed score
    edge: np.ndarray
    run: np.ndarray  # each edge's run, by its number in the slice
    position: np.ndarray  # and the position of its first character in its text
    key: np.ndarray  # of what branches off at each edge: the truncated value falls as this rises
    own: np.ndarray  # by text, where the path left its parent
    taken: list[tuple] = field(default_factory=list)  # by text, the edges that are gone there


class Sampler:
    def __init__(self, path: str, k: int):
        self.bank, self.k = Bank(path), k
        self.vocab = self.bank.vocab
        self.raw = [p.replace(SPACE, " ").encode() for p in self.vocab.text]
        for value, i in enumerate(self.vocab.byte.tolist()):
            if i >= 0:
                self.raw[i] = bytes([value])
        self.raw_size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.raw_at, self.raw_bytes = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(self.raw), np.uint8)

    def runs(self, shown: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of every run, its place in its text, runs by text)."""
        whole = "".join(shown)
        sizes = np.fromiter(map(len, shown), np.int64, len(shown))
        ends = np.cumsum(sizes)
        starts = self.vocab.cuts(whole, (ends - sizes)[sizes > 0])
        code = self.bank.codes(whole, starts)
        number = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - sizes)
        return code, starts - np.repeat(ends - sizes, number), number

    def drawn(self, seeds: np.ndarray, texts: np.ndarray, first_run: np.ndarray, node: np.ndarray, spread: tuple, number: int) -> tuple:
        """Random ways from each text's first run on, its first node being ``node`` if that isn't negative: (edge, run, position, edges by text)."""
        code, place, begin, end = spread
        counts = end[texts] - first_run
        which = ragged(first_run, counts)
        at = self.bank.first.now[code[which]].copy()
        where = place[which]
        head = np.cumsum(counts) - counts
        set_first = np.flatnonzero((node >= 0) & (counts > 0))
        where[head[set_first]] += node[set_first] - at[head[set_first]]
        at[head[set_first]] = node[set_first]
        edge, position, n = self.bank.walk(at, self.bank.last.now[code[which]], np.repeat(seeds[texts], counts), where, number)
        total = np.r_[0, np.cumsum(n)]
        return edge, np.repeat(which, n), position, total[head + counts] - total[head]

    def keys(self, edge: np.ndarray, begin: np.ndarray, noise: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """For what branches off before each edge: log(-log(noise)) less the log of its probability."""
        log = self.bank.log.now[edge]
        total = np.r_[0, np.cumsum(log)]
        before = total[:-1] - np.repeat(total[begin[:-1]], np.diff(begin))
        return np.log(-np.log(noise)) - before * UNIT - rest

    def search(self, seeds: np.ndarray, shown: list[str]) -> tuple[list[Found], np.ndarray]:
        """(the k paths of each text, by number; by text the highest perturbed score that was left out)."""
        bank, n = self.bank, len(shown)
        code, place, counts = self.runs(shown)
        end = np.cumsum(counts)
        spread = code, place, end - counts, end
        every, zeros = np.arange(n), np.zeros(n, np.int64)
        edge, run, position, size = self.drawn(seeds, every, end - counts, zeros - 1, spread, 0)
        begin = np.r_[0, np.cumsum(size)]
        key = self.keys(edge, begin, uniform(np.repeat(seeds, size), 0, position, 1), bank.rest(edge))
        found = [Found(every, begin, gumbel(uniform(seeds, 0, zeros, 2)), edge, run, position, key, zeros - 1, [()] * n)]
        for number in range(1, self.k):
            value, path, at = self.best(found, n)
            alive = found[-1].texts[np.isfinite(value[found[-1].texts])]
            if not len(alive):
                break
            found.append(self.branch(found, alive, value, path, at, seeds, spread, number))
        left = self.best(found, n)[0]
        reached = np.zeros(n, np.int64)
        for x in found:
            reached[x.texts] += 1
        return found, np.where(reached == self.k, left, -np.inf)

    @staticmethod
    def best(found: list[Found], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text, of what branches off its paths: the highest value, its path and the place of its edge there."""
        value, path, at = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for j, x in enumerate(found):
            some = np.flatnonzero(np.diff(x.begin))
            if not len(some):
                continue
            low = np.minimum.reduceat(x.key, x.begin[some])
            hit = np.flatnonzero(x.key == np.repeat(low, np.diff(x.begin)[some]))
            owner = np.searchsorted(x.begin, hit, "right") - 1
            where = np.zeros(len(x.texts), np.int64)
            where[owner[::-1]] = hit[::-1]
            texts, bound = x.texts[some], x.value[some]
            own = bound - np.logaddexp(0.0, low + bound)
            better = own > value[texts]
            value[texts[better]], path[texts[better]], at[texts[better]] = own[better], j, where[some][better]
        return value, path, at

    def branch(self, found: list[Found], texts: np.ndarray, value: np.ndarray, path: np.ndarray, at: np.ndarray, seeds: np.ndarray, spread: tuple, number: int) -> Found:
        """A new path of each of ``texts``: as the popped one to the place where it branches off, and drawn from there."""
        bank = self.bank
        local = np.zeros(len(texts), np.int64)  # edges before the place
        run, taken = local.copy(), []
        for j, x in enumerate(found):
            mine = np.flatnonzero(path[texts] == j)
            local[mine] = at[texts[mine]] - x.begin[np.searchsorted(x.texts, texts[mine])]
        u = uniform(seeds[texts], number, local, 4)
        was, node = local.copy(), local.copy()
        for j, x in enumerate(found):
            mine = np.flatnonzero(path[texts] == j)
            where = at[texts[mine]]
            was[mine], run[mine] = x.edge[where], x.run[where]
            node[mine] = self.source_of(x, where, spread)
            x.key[where] = np.inf
        # the edges of each text's node in a row of their own, so that sums don't depend on other texts
        low, degree = bank.begin.now[node].astype(np.int64), bank.degree.now[node].astype(np.int64)
        column = np.arange(int(degree.max(initial=1)))
        share = np.where(column < degree[:, None], np.exp(bank.log.now[np.minimum(low[:, None] + column, len(bank.log) - 1)] * UNIT), 0.0)
        share[every := np.arange(len(texts)), was - low] = 0.0
        for i, (text, j, t, edge) in enumerate(zip(texts.tolist(), path[texts].tolist(), local.tolist(), was.tolist())):
            x = found[j]
            row = text if j == 0 else int(np.searchsorted(x.texts, text))
            gone = x.taken[row] if x.own[row] == t else ()
            for e in gone:
                share[i, e - low[i]] = 0.0
            taken.append((*gone, edge))
        total = np.cumsum(share, axis=1)
        k = np.minimum((total < (u * total[:, -1])[:, None]).sum(1), degree - 1)
        while len(zero := np.flatnonzero((share[every, k] == 0.0) & (k > 0))):
            k[zero] -= 1
        new, left = low + k, total[:, -1] - share[every, k]
        taken = [(*gone, edge) for gone, edge in zip(taken, new.tolist())]
        more, more_run, more_at, size = self.drawn(seeds, texts, run, bank.target.now[new].astype(np.int64), spread, number)
        # the parents' beginnings, the new edges and the ways from there, end to end by text
        begin = np.r_[0, np.cumsum(local + 1 + size)]
        out = {name: np.empty(int(begin[-1]), np.int64) for name in ("edge", "run", "position")}
        noise, rest = np.full(int(begin[-1]), 0.5), np.full(int(begin[-1]), -np.inf)
        for j, x in enumerate(found):
            mine = np.flatnonzero(path[texts] == j)
            source = ragged(at[texts[mine]] - local[mine], local[mine])
            target = ragged(begin[mine], local[mine])
            for name in out:
                out[name][target] = getattr(x, name)[source]
            turn = begin[mine] + local[mine]
            out["position"][turn], out["run"][turn] = x.position[at[texts[mine]]], run[mine]
        turn = begin[:-1] + local
        out["edge"][turn] = new
        noise[turn] = uniform(seeds[texts], number, local, 3)
        with np.errstate(divide="ignore"):
            rest[turn] = np.where(left > 1e-12, np.log(np.maximum(left, 0.0)), -np.inf)
        tail = ragged(turn + 1, size)
        out["edge"][tail], out["run"][tail], out["position"][tail] = more, more_run, more_at
        noise[tail] = uniform(np.repeat(seeds[texts], size), number, more_at, 1)
        rest[tail] = bank.rest(more)
        return Found(texts, begin, value[texts], **out, key=self.keys(out["edge"], begin, noise, rest), own=local, taken=taken)

    def source_of(self, x: Found, where: np.ndarray, spread: tuple) -> np.ndarray:
        """The nodes that edges of paths leave."""
        run = x.run[where]
        return self.bank.first.now[spread[0][run]] + x.position[where] - spread[1][run]

    def ids_of(self, x: Found) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary numbers of all paths end to end, where each text's begin and the last ends)."""
        sizes = self.bank.n_ids.now[x.edge].astype(np.int64)
        return self.bank.ids.now[ragged(self.bank.id_at.now[x.edge].astype(np.int64), sizes)], np.r_[0, np.cumsum(sizes)][x.begin]

    def decoded(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes that the vocabulary numbers stand for, where those of each range begin and the last end)."""
        sizes = self.raw_size[ids]
        return self.raw_bytes[ragged(self.raw_at[ids], sizes)], np.r_[0, np.cumsum(sizes)][begin]

    def decode(self, ids: np.ndarray) -> str:
        """The text of vocabulary numbers, bytes put together."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode(errors="replace").removeprefix(" ")

    def samples(self, seeds: list[int], texts: list[str | None]) -> list[list[tuple]]:
        """For each text a list of (ids, log_prob, perturbed, log_inclusion, decodes)."""
        out: list[list[tuple]] = [[] for _ in texts]
        for which, ids, begin, *values in self.numbered(seeds, texts):
            for t, a, b, *own in zip(which.tolist(), begin[:-1].tolist(), begin[1:].tolist(), *(v.tolist() for v in values)):
                out[t].append((ids[a:b], *own))
        return out

    def numbered(self, seeds: list[int], texts: list[str | None]):
        """By path number (texts, ids end to end, their ranges, log_prob, perturbed, log_inclusion, decodes), each for those texts that have such a path."""
        shown = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        found, left = self.search(np.array([s & 0xFFFFFFFFFFFFFFFF for s in seeds], np.uint64), shown)
        plain = [s.replace(SPACE, " ").encode() for s in shown]
        for x in found:
            ids, begin = self.ids_of(x)
            total = np.r_[0, np.cumsum(self.bank.log.now[x.edge])]
            log = (total[x.begin[1:]] - total[x.begin[:-1]]) * UNIT
            gap = log - left[x.texts]
            with np.errstate(over="ignore", divide="ignore"):
                inclusion = np.where(gap > 30, 0.0, np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.clip(gap, -30, 30))))))
            got, at = self.decoded(ids, begin)
            wanted = [plain[t] for t in x.texts.tolist()] if len(x.texts) < len(plain) else plain
            decodes = same_ranges(got, at, wanted)
            yield x.texts, ids, begin, log, x.value, inclusion, decodes


@lru_cache(2)
def sampler(path: str, k: int) -> Sampler:
    return Sampler(path, k)


def segmentations(docs: DataFrame, path: str, k: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sample, n_pieces, log_prob, perturbed, log_inclusion, decodes, ids): up to k rows per row of ``docs``, sample 1 the best."""
    rows = docs.select(F.col(key).alias(key), F.xxhash64(key).alias("seed"), F.col(text).alias("text"))
    schema = with_fields(rows.select(key), COLUMNS)

    def work(batch: pa.RecordBatch):
        seeds, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for a, b in slices(texts, CHARS):
            for j, (which, ids, begin, *values, decodes) in enumerate(sampler(path, k).numbered(seeds[a:b], texts[a:b])):
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))
                own = batch.column(0).take(pa.array(which + a))
                columns = [own, pa.array(np.full(len(which), j + 1, np.int32)), pa.array(np.diff(begin).astype(np.int32)), *map(pa.array, values), pa.array(decodes, pa.bool_()), lists]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return arrow_map(rows, work, schema)
