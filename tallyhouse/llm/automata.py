"""Weighted acyclic automata over sequences of symbols, as arrays.

A path from the root spells a sequence; an arc's weight is the weight of the sequence that ends with it, 0 if that is only a prefix of
others. States with equal arcs (symbol, weight, target) are one state.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tallyhouse.llm import shards as S
from tallyhouse.llm import words as W


class Level(NamedTuple):
    """Prefixes of one length, sorted by parent (a place in the level before; 0 in the first) and symbol."""

    parent: np.ndarray
    label: np.ndarray
    weight: np.ndarray


class Tree(NamedTuple):
    """Weighted sequences with their prefixes, level by level; labels are places in the sorted symbols."""

    symbols: pa.Array
    levels: list[Level]


class Automaton(NamedTuple):
    """Arcs of state s: first[s] to first[s + 1], sorted by label. State 0 has none; the last state is the root."""

    symbols: pa.Array
    first: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray


def ranked(symbols: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct symbols in order of their bytes, and the place of each given one."""
    coded = symbols.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]


def tree(symbols: pa.Array, columns: list[np.ndarray]) -> tuple[Tree, np.ndarray]:
    """Counts of all prefixes of the rows: sequences of labels, column by column, -1 behind their ends. And the order of the rows in
    which the tree was built."""
    base = len(symbols) + 1
    pack = max(1, 62 // max(1, base.bit_length()))
    keys = []
    for start in range(0, len(columns), pack):
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns[start : start + pack]:
            key = key * base + c + 1
        keys.append(key)
    order = np.lexsort(keys[::-1])
    levels, new, parent = [], np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
        new[:1] = True
        here = c >= 0
        begin = np.flatnonzero(new & here)
        place = np.cumsum(new & here) - 1
        levels.append(Level(parent[begin], c[begin], np.bincount(place[here], minlength=len(begin)).astype(np.int64)))
        parent = place
    while levels and not len(levels[-1].label):
        levels.pop()
    return Tree(symbols, levels), order


def frozen(t: Tree) -> Automaton:
    """The minimal automaton: from the ends of the sequences upwards, each state in sorted order is looked up among those frozen before
    and only added if none has the same arcs. States with one arc are looked up all at once."""
    sizes = np.array([1] + [len(v.label) for v in t.levels])
    begin = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    parent = np.concatenate([np.zeros(1, np.int64), *[v.parent + b for v, b in zip(t.levels, begin, strict=False)]])
    label = np.concatenate([np.zeros(1, np.int64), *[v.label for v in t.levels]])
    weight = np.concatenate([np.zeros(1, np.int64), *[v.weight for v in t.levels]])
    arcs = np.bincount(parent[1:], minlength=n)
    child = np.concatenate(([1], np.cumsum(arcs) + 1))  # a node's children stand together, in the order of the nodes
    height = np.zeros(n, np.int64)
    for b, size in zip(begin[:0:-1], sizes[:0:-1], strict=True):
        np.maximum.at(height, parent[b : b + size], height[b : b + size] + 1)
    state = np.zeros(n, np.int64)
    chunks, counts, states = [], [np.zeros(1, np.int64)], 1
    for h in range(1, int(height.max()) + 1):
        nodes = np.flatnonzero(height == h)
        single = nodes[arcs[nodes] == 1]
        if len(single):
            c = child[single]
            by = np.lexsort((state[c], weight[c], label[c]))
            cols = np.stack((label[c], weight[c], state[c]))[:, by]
            fresh = np.ones(len(by), bool)
            fresh[1:] = (cols[:, 1:] != cols[:, :-1]).any(0)
            state[single[by]] = states + np.cumsum(fresh) - 1
            chunks.append(cols[:, fresh])
            counts.append(np.ones(int(fresh.sum()), np.int64))
            states += int(fresh.sum())
        several = nodes[arcs[nodes] > 1]
        if len(several):
            length = arcs[several]
            at = np.repeat(child[several] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            cols = np.stack((label[at], weight[at], state[at]), axis=1)
            register: dict[bytes, int] = {}
            kept, ends = np.zeros(len(several), bool), np.cumsum(length).tolist()
            found, a = np.empty(len(several), np.int64), 0
            for k, b in enumerate(ends):
                key = cols[a:b].tobytes()
                known = register.get(key)
                if known is None:
                    register[key] = known = states
                    states += 1
                    kept[k] = True
                found[k] = known
                a = b
            state[several] = found
            chunks.append(cols[np.repeat(kept, length)].T)
            counts.append(length[kept])
    columns = np.concatenate(chunks, axis=1) if chunks else np.zeros((3, 0), np.int64)
    return Automaton(t.symbols, np.concatenate(([0], np.cumsum(np.concatenate(counts)))), *columns)


def dumped(a: Automaton) -> bytes:
    data, offsets = W.byte_view(a.symbols)
    parts = [data.tobytes(), *(S.planes(x) for x in (np.diff(offsets), np.diff(a.first), a.label, a.weight, a.target))]
    raw = b"".join(len(p).to_bytes(8, "little") + p for p in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def loaded(blob: bytes) -> Automaton:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    parts, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        parts.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    lengths, counts, label, weight, target = (S.unplaned(p).astype(np.int64) for p in parts[1:])
    ends = np.concatenate(([0], np.cumsum(lengths)))
    symbols = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(parts[0])])
    return Automaton(symbols, np.concatenate(([0], np.cumsum(counts))), label, weight, target)


def union(automata: Iterable[Automaton]) -> Tree:
    """All sequences of the automata, weights summed: equal prefixes meet level by level, whatever states spell them. Given an
    iterator, it lets go of each automaton once its arcs stand beside the others'."""
    automata = list(automata)
    symbols, rank = ranked(pa.concat_arrays([a.symbols for a in automata]))
    size = np.cumsum([0] + [len(a.symbols) for a in automata])
    states = np.cumsum([0] + [len(a.first) - 1 for a in automata])
    arcs = np.cumsum([0] + [len(a.label) for a in automata])
    whole = np.int32 if max(size[-1], states[-1]) < 1 << 31 else np.int64
    first, count = np.empty(states[-1], np.int64), np.empty(states[-1], np.int64)
    label, weight, target = np.empty(arcs[-1], whole), np.empty(arcs[-1], np.int64), np.empty(arcs[-1], whole)
    for k in reversed(range(len(automata))):
        a, own, at = automata.pop(), slice(states[k], states[k + 1]), slice(arcs[k], arcs[k + 1])
        first[own], count[own] = a.first[:-1] + arcs[k], np.diff(a.first)
        label[at], weight[at], target[at] = rank[size[k] + a.label], a.weight, a.target + states[k]
        del a
    at, node, levels = states[1:] - 1, np.zeros(len(states) - 1, np.int64), []
    while len(at):
        n = count[at]
        arc = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if not len(arc):
            break
        key = np.repeat(node, n) * len(symbols) + label[arc]
        distinct, place = np.unique(key, return_inverse=True)
        total = np.bincount(place, weight[arc].astype(np.float64)).astype(np.int64)  # exact below 2 ** 53
        levels.append(Level(distinct // len(symbols), distinct % len(symbols), total))
        at, node = target[arc], place
        on = count[at] > 0
        at, node = at[on], node[on]
    return Tree(symbols, levels)


def unfolded(t: Tree) -> Automaton:
    """The tree as it is: a state for each prefix that goes on."""
    sizes = np.array([1] + [len(v.label) for v in t.levels])
    begin, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    parent = np.concatenate([np.zeros(0, np.int64), *[v.parent + b for v, b in zip(t.levels, begin, strict=False)]])
    label, weight = (np.concatenate([np.zeros(0, np.int64), *[v[k] for v in t.levels]]) for k in (1, 2))
    arcs = np.bincount(parent, minlength=n)
    goes = arcs > 0
    goes[0] = True
    state = np.where(goes, goes.sum() + 1 - np.cumsum(goes), 0)  # the root is the last state
    c, child = arcs[goes][::-1], (np.cumsum(arcs) - arcs)[goes][::-1]
    at = np.repeat(child - (np.cumsum(c) - c), c) + np.arange(n - 1)
    return Automaton(t.symbols, np.concatenate(([0, 0], np.cumsum(c))), label[at], weight[at], state[at + 1])


def _distinct(places: np.ndarray) -> np.ndarray:
    """Of sorted places."""
    new = np.ones(len(places), bool)
    new[1:] = places[1:] != places[:-1]
    return places[new]


def _chosen(t: Tree, nodes: list[np.ndarray], weight: list[np.ndarray]) -> Tree:
    """The tree of some nodes of each level; their ancestors are among them."""
    levels = []
    for k, (v, at) in enumerate(zip(t.levels, nodes, strict=True)):
        if not len(at):
            break
        parent = np.searchsorted(nodes[k - 1], v.parent[at]) if k else v.parent[at]
        levels.append(Level(parent, v.label[at], weight[k]))
    used = np.zeros(len(t.symbols), bool)
    for v in levels:
        used[v.label] = True
    rank = np.cumsum(used) - 1
    return Tree(t.symbols.take(pa.array(np.flatnonzero(used))), [v._replace(label=rank[v.label]) for v in levels])


def pruned(t: Tree, least: int) -> Tree:
    """Sequences of a weight of `least` or more, and their prefixes."""
    nodes, above = [], np.zeros(0, np.int64)
    for v in reversed(t.levels):
        here = v.weight >= least
        here[above] = True
        nodes.append(np.flatnonzero(here))
        above = _distinct(v.parent[nodes[-1]])
    nodes.reverse()
    weight = [np.where(v.weight[at] >= least, v.weight[at], 0) for v, at in zip(t.levels, nodes, strict=True)]
    return _chosen(t, nodes, weight)


def routes(t: Tree, depth: int, ranges: int, shift: int = 32) -> list[np.ndarray]:
    """The prefix range of each sequence: that of its first `depth` symbols, or of all if it has fewer. The 32 bits from `shift` on of
    their hash decide."""
    mark = np.fromiter((xxhash.xxh3_64_intdigest(s) for s in t.symbols.to_pylist()), np.uint64, len(t.symbols))
    out, path = [], np.zeros(1, np.uint64)
    for k, v in enumerate(t.levels):
        path = W.mixed(path[v.parent] * W.BASE + mark[v.label]) if k < depth else path[v.parent]
        out.append(((path >> np.uint64(shift) & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64))
    return out


def parted(t: Tree, route: list[np.ndarray]):
    """(range, tree) for each range that has sequences: these, and their prefixes with weight 0."""
    order = [np.argsort(r, kind="stable") for r in route]
    held = [r[o] for r, o in zip(route, order, strict=True)]
    for k in np.unique(np.concatenate(route) if route else np.zeros(0, np.int64)).tolist():
        own = [o[slice(*np.searchsorted(h, [k, k + 1]))] for o, h in zip(order, held, strict=True)]
        nodes, above = [], np.zeros(0, np.int64)
        for v, at in zip(reversed(t.levels), reversed(own), strict=True):
            nodes.append(_distinct(np.sort(np.concatenate((at, above)), kind="stable")) if len(above) else at)
            above = _distinct(v.parent[nodes[-1]])  # parents rise with the places
        nodes.reverse()
        yield k, _chosen(t, nodes, [np.where(r[at] == k, v.weight[at], 0) for v, r, at in zip(t.levels, route, nodes, strict=True)])


def composed(questions: Tree, a: Automaton) -> list[np.ndarray]:
    """For each sequence of `questions`, level by level, its weight in a (0 if it has none): both are walked in step."""
    n, out = len(a.symbols), []
    code = pc.index_in(questions.symbols, value_set=a.symbols).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    arcs = np.repeat(np.arange(len(a.first) - 1), np.diff(a.first)) * max(1, n) + a.label  # sorted: states rise, labels rise within
    state = np.array([len(a.first) - 2])
    for v in questions.levels:
        label, start = code[v.label], state[v.parent]
        key = start * max(1, n) + label
        at = np.minimum(np.searchsorted(arcs, key), max(0, len(arcs) - 1))
        hit = (label >= 0) & (arcs[at] == key) if len(arcs) else np.zeros(len(key), bool)
        out.append(np.where(hit, a.weight[at], 0) if len(arcs) else np.zeros(len(key), np.int64))
        state = np.where(hit, a.target[at], 0) if len(arcs) else np.zeros(len(key), np.int64)
    return out


def spelled(t: Tree) -> list[tuple[pa.Array, pa.Array]]:
    """For each level, the first symbols and the others, joined by one space."""
    out: list[tuple[pa.Array, pa.Array]] = []
    for k, v in enumerate(t.levels):
        own = t.symbols.take(pa.array(v.label))
        if k == 0:
            out.append((own, pa.array([""] * len(own), pa.large_string())))
            continue
        head, rest = (x.take(pa.array(v.parent)) for x in out[-1])
        out.append((head, own if k == 1 else pc.binary_join_element_wise(rest, own, pa.scalar(" ", pa.large_string()))))
    return out
