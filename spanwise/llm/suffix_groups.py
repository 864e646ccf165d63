"""Suffix arrays by linear grouping, for many small texts at once.

The first phase starts from groups of suffixes by first byte and takes them in descending
order.  Each suffix of the group at hand finds its previous smaller suffix, by pointers
over suffixes already done; suffixes found so are moved, within their own group, behind
those that were not, by how many of the group they lead to, and their known prefix grows
by so many of the group's prefixes.  At the end each group holds the suffixes with one
Lyndon prefix, and groups stand in the order of those prefixes.

The second phase walks the suffix array upwards, as far as places are filled at a time.  A
suffix ends the Lyndon prefixes of some suffixes before it in the text, and those take the
next free places of their groups.  No suffix is renamed again.

All texts take their steps together: one numpy pass handles the highest open group of
every text.  A text is a row of bytes plus one, with zeros (which are smallest, and whose
own order does not matter) before, between and after its strings.
"""

from __future__ import annotations

import numpy as np


def _flat(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each range, one after another."""
    total = np.cumsum(count)
    return np.repeat(begin - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)


def lyndon_groups(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First phase: of each place the start of its group, and the length of its Lyndon prefix.

    symbols holds all texts in a row, first where each begins (one more at the end); each
    text begins and ends with 0.  Group starts count from the text's begin.
    """
    n, texts = len(symbols), len(first) - 1
    base = np.repeat(first[:-1], np.diff(first))
    order = np.lexsort((np.arange(n), symbols, base))
    new = np.ones(n, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (base[order][1:] != base[order][:-1])
    opens = np.flatnonzero(new)
    sizes = np.diff(np.append(opens, n))
    group = np.empty(n, np.int64)  # absolute place of the group's start
    group[order] = np.repeat(opens, sizes)
    length, prev = np.ones(n, np.int64), np.zeros(n, np.int64)
    size, start_of_end, chunk, chunk_size = (np.zeros(n, np.int64) for _ in range(4))
    size[opens], start_of_end[opens + sizes - 1], chunk[opens], chunk_size[opens] = sizes, opens, opens, sizes
    log = np.empty(2 * n + 1, np.int64)  # members of groups in the order groups arose; some have moved on
    log[:n], logged = order, n
    current = start_of_end[first[1:] - 1]
    current = current[symbols[order[current]] > 0] if texts else current
    while len(current):
        member = log[_flat(chunk[current], chunk_size[current])]
        own = np.repeat(current, chunk_size[current])
        still = group[member] == own
        member, own = member[still], own[still]
        p = member - 1
        open_ = np.arange(len(member))
        while len(open_):
            at = p[open_]
            there = group[at]
            mine = own[open_]
            open_ = open_[there >= mine]
            at, there, mine = p[open_], group[p[open_]], own[open_]
            p[open_] = np.where(there > mine, prev[at], at - 1)
        prev[member] = p
        grown = symbols[p] > 0
        p, by = p[grown], length[member[grown]]
        if len(p):
            ordered = np.sort(p)
            lead = np.ones(len(ordered), bool)
            lead[1:] = ordered[1:] != ordered[:-1]
            at = np.flatnonzero(lead)
            times = np.diff(np.append(at, len(ordered)))
            moved = ordered[at]
            add = np.empty(len(p), np.int64)
            add = by[np.argsort(p, kind="stable")][at]
            old = group[moved]
            by_group = np.lexsort((times, old))
            moved, times, old, add = moved[by_group], times[by_group], old[by_group], add[by_group]
            length[moved] += times * add
            seg = np.ones(len(moved), bool)
            seg[1:] = old[1:] != old[:-1]
            sub = seg.copy()
            sub[1:] |= times[1:] != times[:-1]
            seg_at, sub_at = np.flatnonzero(seg), np.flatnonzero(sub)
            seg_size, sub_size = np.diff(np.append(seg_at, len(moved))), np.diff(np.append(sub_at, len(moved)))
            g = old[seg_at]
            rest = size[g] - seg_size
            start = np.repeat(g + rest - seg_at, seg_size)[sub_at] + sub_at
            kept = rest > 0
            size[g[kept]] = rest[kept]
            start_of_end[g[kept] + rest[kept] - 1] = g[kept]
            size[start], start_of_end[start + sub_size - 1] = sub_size, start
            group[moved] = np.repeat(start, sub_size)
            if logged + len(moved) > len(log):
                log = np.concatenate([log, np.empty(len(log), np.int64)])
            log[logged : logged + len(moved)] = moved
            chunk[start], chunk_size[start] = logged + sub_at, sub_size
            logged += len(moved)
        current = start_of_end[current - 1]
        current = current[symbols[log[chunk[current]]] > 0]
    return group, length


def suffix_array(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, text by text (zeros first)."""
    group, length = lyndon_groups(symbols, first)
    n = len(symbols)
    out = np.full(n, -1, np.int64)
    zeros = np.flatnonzero(symbols == 0)
    texts = np.searchsorted(first, zeros, side="right") - 1
    count = np.bincount(texts, minlength=len(first) - 1)
    out[_flat(first[:-1], count)] = zeros
    inner = np.flatnonzero(symbols > 0)
    ends = inner + length[inner]
    order = np.argsort(ends, kind="stable")
    inner, ends = inner[order], ends[order]
    begins = np.searchsorted(ends, np.arange(n + 1))
    free = np.arange(n)  # the next free place of the group that starts there
    filled = out >= 0
    at, stop = first[:-1].copy(), first[1:]
    while True:
        live = at < stop
        at, stop = at[live], stop[live]
        if not len(at):
            return out
        # all places filled without a gap are final: they are walked at once, in order
        gaps = np.append(np.flatnonzero(~filled), n)
        upto = np.minimum(gaps[np.searchsorted(gaps, at)], stop)
        s = out[_flat(at, upto - at)]
        i = inner[_flat(begins[s], begins[s + 1] - begins[s])]
        g = group[i]
        order = np.argsort(g, kind="stable")
        i, g = i[order], g[order]
        lead = np.ones(len(g), bool)
        lead[1:] = g[1:] != g[:-1]
        heads = np.flatnonzero(lead)
        count = np.diff(np.append(heads, len(g)))
        place = _flat(free[g[heads]], count)
        out[place], filled[place] = i, True
        free[g[heads]] += count
        at = upto
