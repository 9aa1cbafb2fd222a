"""Removal of repeated substrings, by suffix sorting with a shallow and a deep phase.

Asked for is each byte that lies in a string of LENGTH bytes which also starts in a document with a smaller id. Sorting every suffix would
ship LENGTH times the corpus, so only those suffixes are sorted that local comparison cannot settle:

1. Anchors: of each LENGTH-byte string the GRAM-byte substring with the least hash. Equal strings have equal anchors, and one
   anchor serves a run of neighbouring strings, its super-window (about every 16th byte starts one). Documents are dealt to groups of about
   GROUP_BYTES by their rows' places; a group sends (anchor, super-window hash, id) once for each different super-window, with its least id.
2. By anchor: a super-window that a smaller document has too is covered whole. If an anchor has several different super-windows in
   different documents, the first document of each sends the super-window's bytes. Anchors with over HOT entries
   send their strings one by one, dealt by their own hash and once for each group, so that no common passage lands in one task.
3. The LENGTH-byte prefixes of all suffixes sent to a bucket are sorted: multikey quicksort over digits of 8 bytes down to SHALLOW bytes
   (three-way partitions, vectorised), then a blind trie orders each remaining group with a long common prefix. Equal neighbours share a
   string, whose smallest id covers it in all other documents.
4. Back in the documents' groups the answers are spread over the texts.

A null text is empty. A null id counts as larger than all others, and such rows don't cover each other. Rows that repeat an id don't cover each other
either, as no id is smaller. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import safe_text

LENGTH = 50
GRAM = 20
SHALLOW = 24
HOT = 2000
GROUP_BYTES = 12 << 20
#: Longest stretch whose places fit beside 44 bits of hash.
STRETCH = (1 << 20) - 1
LAST = 2**63 - 1
COVERED, OPEN, SPLIT = 0, 1, 2
_P = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 2**64))


def super_windows(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start, anchor hash (44 bits) and super-window hash (48 bits) of each run of strings with one anchor; raw: at most STRETCH bytes."""
    n = len(raw) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = {1: raw.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8, 16):
        h[2 * k] = h[k][:-k] * _power(k) + h[k][k:]
    gram = h[16][: len(raw) - GRAM + 1] * _power(4) + h[4][16 : 16 + len(raw) - GRAM + 1]
    whole = h[32][:n] * _power(18) + h[16][32 : 32 + n] * _power(2) + h[2][48 : 48 + n]
    low = np.uint64(STRETCH)
    least = (_mixed(gram) & ~low) | np.arange(len(gram), dtype=np.uint64)
    for k in (1, 2, 4, 8):
        least = np.minimum(least[:-k], least[k:])
    least = np.minimum(least[:n], least[15 : 15 + n])
    inside = np.ones(n, bool)
    for e in ends:  # strings don't cross the end of a document
        inside[max(0, e - LENGTH + 1) : e] = False
    at = (least & low).astype(np.int64)
    change = np.ones(n, bool)
    change[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    stop = np.ones(n, bool)
    stop[:-1] = change[1:] | ~inside[1:]
    last = np.flatnonzero(stop & inside)
    place = (at[first] - first).astype(np.uint64)
    both = _mixed(whole[first] + _mixed(whole[last] + np.uint64(7)) * _M2 + (last - first).astype(np.uint64) * _M1 + place)
    return first, last, least[first] >> np.uint64(20), both >> np.uint64(16)


class Group:
    """The documents of one group, in one buffer, with their super-windows."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        texts = table.column("raw").to_pylist()
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        self.rank_id = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.starts = self.ends - [len(t) for t in self.texts]
        self.raw = np.frombuffer(b"".join(self.texts), np.uint8)
        found = [[], [], [], []]
        for a, b in self._stretches():
            inner = self.ends[(self.ends > a) & (self.ends <= b)] - a
            one = super_windows(self.raw[a:b], inner)
            for k, x in enumerate(one):
                found[k].append(x + a if k < 2 else x)
        self.first, self.last, self.anchor, self.super = (np.concatenate([np.zeros(0, t), *x]) for x, t in zip(found, (np.int64, np.int64, np.uint64, np.uint64)))
        self.row = np.searchsorted(self.ends, self.first, "right")
        self.doc = self.rank_id[self.row] if len(self.rank_id) else np.zeros(0, np.int64)
        self.tag = _tag(self.anchor, self.super)
        order = np.lexsort((self.first, self.doc, self.tag))
        heads = order[np.flatnonzero(np.diff(self.tag[order], prepend=~self.tag[order[:1]]))] if len(order) else order
        #: the first super-window of each kind, from the smallest document; the smallest document of each one's kind
        self.heads = heads
        kinds = np.searchsorted(self.tag[heads], self.tag)
        self.least = self.doc[heads][kinds] if len(heads) else self.doc

    def _stretches(self):
        a = 0
        for e in (*self.ends.tolist(),):
            start = a
            if e - start > STRETCH:
                inner = self.ends[(self.ends > start) & (self.ends < e)]
                if len(inner):
                    yield start, int(inner[-1])
                    start = int(inner[-1])
                while e - start > STRETCH:  # one very long document, in overlapping parts
                    yield start, start + STRETCH
                    start += STRETCH - LENGTH + 1
                a = start
        if len(self.raw) > a:
            yield a, len(self.raw)

    def key(self, of: np.ndarray | None = None) -> np.ndarray:
        return _key(self.doc, self.tag) if of is None else _key(self.doc[of], self.tag[of])

    def hot_strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, document and hash of each string in the super-windows chosen."""
        starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(self.first[i], self.last[i] + 1) for i in chosen)])
        docs = np.repeat(self.doc[chosen], self.last[chosen] - self.first[chosen] + 1)
        return starts, docs, np.fromiter((xxhash.xxh64_intdigest(self.raw[s : s + LENGTH].tobytes()) for s in starts.tolist()), np.uint64, len(starts))


def _tag(anchor: np.ndarray, sup: np.ndarray) -> np.ndarray:
    """The kind of a super-window, in 64 bits from the 92 of anchor and hash: 48 bits alone would meet by chance in a large corpus."""
    return _mixed(anchor * _M1 + _mixed(sup + np.uint64(3)))


def _key(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return _mixed(doc.astype(np.uint64) * np.uint64(_P) + _mixed(tag))


def _least(docs: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each tag's first entry with the smallest document, and that document for every entry."""
    order = np.lexsort((docs, tags))
    heads = order[np.flatnonzero(np.r_[True, tags[order][1:] != tags[order][:-1]])] if len(order) else order
    return heads, docs[heads][np.searchsorted(tags[heads], tags)] if len(heads) else docs


# -- rows between the steps: (bucket, grp, kind, body), where body holds arrays


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, byte by byte, so that equal high bytes lie together."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel().astype(np.uint64)


ROWS = "bucket int, grp int, kind int, a binary, b binary, c binary, d binary"


def _rows(found: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    cols = list(zip(*found)) or [()] * 7
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("bucket", "grp", "kind", "a", "b", "c", "d"), cols, kinds)})


def _spread(keys: np.ndarray, buckets: int):
    """Places of the entries of each bucket."""
    bucket = (_mixed(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(order) else []
    for a, b in pairwise(cuts):
        yield int(bucket[order[a]]), order[a:b]


def send_windows(table: pa.Table, buckets: int) -> pa.Table:
    g, out = Group(table), []
    grp = table.column("grp")[0].as_py()
    for bucket, own in _spread(g.anchor[g.heads], buckets):
        own = g.heads[own]
        own = own[np.argsort(g.anchor[own], kind="stable")]
        steps = np.diff(g.anchor[own], prepend=np.uint64(0))
        wide = 4 if not len(steps) or int(steps.max()) < 2**32 else 6
        docs = 4 if int(g.doc[own].max()) < 2**32 and int(g.doc[own].min()) >= 0 else 8
        out.append((bucket, grp, 0, _planes(steps, wide), _planes(g.super[own], 6), _planes(g.doc[own].view(np.uint64), docs), b""))
    return _rows(out)


def judge_windows(table: pa.Table) -> pa.Table:
    n, anchor, sup, doc, grp = 0, [], [], [], []
    for a, b, c, g in zip(*(table.column(x).to_pylist() for x in ("a", "b", "c", "grp"))):
        n = len(b) // 6
        anchor.append(np.cumsum(_numbers(a, len(a) // n), dtype=np.uint64))
        sup.append(_numbers(b, 6))
        doc.append(_numbers(c, len(c) // n).view(np.int64))
        grp.append(np.full(n, g, np.int32))
    anchor, sup, doc, grp = map(np.concatenate, (anchor, sup, doc, grp))
    order = np.lexsort((doc, sup, anchor))
    anchor, sup, doc, grp = anchor[order], sup[order], doc[order], grp[order]
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
    new_kind = new_anchor | np.r_[True, sup[1:] != sup[:-1]]
    kind_of = np.cumsum(new_kind) - 1
    covered = doc > doc[np.flatnonzero(new_kind)][kind_of]
    starts = np.flatnonzero(new_anchor)
    which = np.cumsum(new_anchor) - 1
    kinds = np.add.reduceat(new_kind.astype(np.int64), starts)
    several = (kinds > 1) & (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts))
    verdict = np.where(covered, COVERED, np.where(new_kind & several[which], np.where(kinds[which] > HOT, SPLIT, OPEN), -1))
    told = np.flatnonzero(verdict >= 0)
    told = told[np.lexsort((verdict[told], grp[told]))]
    cuts = np.flatnonzero(np.r_[True, (np.diff(grp[told]) != 0) | (np.diff(verdict[told]) != 0), True]) if len(told) else []
    return _rows([(0, int(grp[told[i]]), int(verdict[told[i]]), _planes(_key(doc[told[i:j]], _tag(anchor[told[i:j]], sup[told[i:j]])), 8), b"", b"", b"") for i, j in pairwise(cuts)])


def _told(verdicts: pa.Table, kind: int) -> np.ndarray:
    raw = [x for x, k in zip(verdicts.column("a").to_pylist(), verdicts.column("kind").to_pylist()) if k == kind]
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(_numbers(x, 8) for x in raw)]))


def _within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def send_strings(table: pa.Table, verdicts: pa.Table, buckets: int) -> pa.Table:
    """Bytes of the super-windows that are open: tag, document, lengths, bytes."""
    if not table.num_rows or not verdicts.num_rows:
        return _rows([])
    g, out = Group(table), []
    grp = table.column("grp")[0].as_py()
    keys = g.key(g.heads)

    def put(bucket_keys: np.ndarray, first: np.ndarray, last: np.ndarray, docs: np.ndarray, tags: np.ndarray) -> None:
        for bucket, own in _spread(bucket_keys, buckets):
            body = b"".join(g.raw[a : b + LENGTH].tobytes() for a, b in zip(first[own].tolist(), last[own].tolist()))
            out.append((bucket, grp, 0, _planes(tags[own], 8), _planes(docs[own].view(np.uint64), 8), (last - first)[own].astype(np.uint8).tobytes(), body))

    own = g.heads[_within(keys, _told(verdicts, OPEN))]
    put(g.anchor[own], g.first[own], g.last[own], g.doc[own], g.tag[own])
    starts, docs, tags = g.hot_strings(g.heads[_within(keys, _told(verdicts, SPLIT))])
    heads, _ = _least(docs, tags)
    put(tags[heads], starts[heads], starts[heads], docs[heads], tags[heads])
    return _rows(out)


# -- suffix sorting


def multikey(raw: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first `depth` bytes, and the number of each one's group of equal prefixes. Each pass partitions the groups that are left by 8 more bytes."""
    digits = np.zeros(len(raw), ">u8")
    padded = np.r_[raw, np.zeros(8, np.uint8)]
    digits = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(raw)]
    order, group = at.copy(), np.zeros(len(at), np.int64)
    for d in range(0, depth, 8):
        size = np.bincount(group)
        left = np.flatnonzero(size[group] > 1)
        if not len(left):
            break
        digit = np.ascontiguousarray(digits[order[left] + d]).view(">u8").ravel().astype(np.uint64)
        turn = np.lexsort((digit, group[left]))
        order[left], digit = order[left][turn], digit[turn]
        new = np.zeros(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        new[left[1:]] |= (digit[1:] != digit[:-1]) & (group[left[1:]] == group[left[:-1]])
        group = np.cumsum(new)
    return order, group


def blind_trie(strings: list[bytes], depth: int) -> list[list[int]]:
    """Numbers of the strings in sorted order, equal ones together. All share their first `depth` bytes and have one length.

    A node holds the place where its strings first differ; a search skips what lies between such places, then compares once with the leaf it came to."""
    root: object = [0]
    for i, s in enumerate(strings[1:], 1):
        node = root
        while isinstance(node, tuple):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[0]]
        if other == s:
            node.append(i)
            continue
        k = depth
        while other[k] == s[k]:
            k += 1
        node, above = root, None
        while isinstance(node, tuple) and node[0] < k:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == k:
            node[1][s[k]] = [i]
            continue
        split = (k, {other[k]: node, s[k]: [i]})
        if above is None:
            root = split
        else:
            above[1][s[above[0]]] = split
    out: list[list[int]] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out.append(node)
    return out


def classes(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `length` bytes, and the number of each one's class of equal strings."""
    order, group = multikey(raw, at, shallow)
    if not len(order):
        return order, group
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    head = order[starts][group]
    views = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.ones(len(order), bool)
    for i in range(0, len(order), 200_000):
        same[i : i + 200_000] = (views[order[i : i + 200_000], shallow:] == views[head[i : i + 200_000], shallow:]).all(1)
    ends = np.r_[starts[1:], len(order)]
    new = np.zeros(len(order), bool)
    new[starts] = True
    for k in np.flatnonzero(~np.logical_and.reduceat(same, starts)):  # deep: groups with different strings
        a, b = int(starts[k]), int(ends[k])
        own = order[a:b]
        sets = blind_trie([raw[s : s + length].tobytes() for s in own.tolist()], shallow)
        order[a:b] = own[[i for s in sets for i in s]]
        new[a + np.cumsum([0, *(len(s) for s in sets[:-1])])] = True
    return order, np.cumsum(new) - 1


def judge_strings(table: pa.Table) -> pa.Table:
    """Which strings of the super-windows sent start in a smaller document: (document and tag, a bit for each start) by group."""
    tags, docs, grp, extra, bodies = [], [], [], [], []
    for a, b, c, d, g in zip(*(table.column(x).to_pylist() for x in ("a", "b", "c", "d", "grp"))):
        tags.append(_numbers(a, 8))
        docs.append(_numbers(b, 8).view(np.int64))
        extra.append(np.frombuffer(c, np.uint8).astype(np.int64))
        grp.append(np.full(len(c), g, np.int64))
        bodies.append(d)
    tags, docs, grp, extra = map(np.concatenate, (tags, docs, grp, extra))
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    size = extra + LENGTH
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(tags)), extra + 1)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
    at = begin[owner] + offset
    place = np.full(len(raw), -1)
    place[at] = np.arange(len(at))
    order, group = classes(raw, at)
    own = place[order]
    doc = docs[owner[own]]
    least = np.minimum.reduceat(doc, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))[group]
    hit = own[doc > least]
    bits = np.zeros(len(tags), np.uint64)
    np.bitwise_or.at(bits, owner[hit], np.uint64(1) << offset[hit].astype(np.uint64))
    some = np.flatnonzero(bits)
    some = some[np.argsort(grp[some], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, np.diff(grp[some]) != 0, True]) if len(some) else []
    return _rows([(0, int(grp[some[i]]), 9, _planes(_key(docs[some[i:j]], tags[some[i:j]]), 8), _planes(bits[some[i:j]], 4), b"", b"") for i, j in pairwise(cuts)])


# -- back to the texts

SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def settle(table: pa.Table, verdicts: pa.Table, with_text: bool = False) -> pa.Table:
    """A row for each document: sizes, digest and, on demand, the text that is kept."""
    g = Group(table)
    start = np.zeros(len(g.raw) + 1, np.int32)  # string starts that are covered, as runs

    def cover(first: np.ndarray, last: np.ndarray) -> None:
        np.add.at(start, first, 1)
        np.add.at(start, np.minimum(last + LENGTH, len(g.raw)), -1)

    key = g.key()
    whole = (g.doc > g.least) | _within(key, _told(verdicts, COVERED))
    cover(g.first[whole], g.last[whole])
    tags, bits = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for a, b, k in zip(*(verdicts.column(x).to_pylist() for x in ("a", "b", "kind"))):
        if k == 9:
            tags.append(_numbers(a, 8)), bits.append(_numbers(b, 4))
    tags, bits = np.concatenate(tags), np.concatenate(bits)
    order = np.argsort(tags)
    tags, bits = tags[order], bits[order]
    split = _within(key, _told(verdicts, SPLIT)) & ~whole
    some = np.flatnonzero(_within(key, tags) & ~whole & ~split)
    marks = bits[np.searchsorted(tags, key[some])]
    for o in range(LENGTH - GRAM + 1):
        own = some[(marks >> np.uint64(o)) & np.uint64(1) == 1]
        cover(g.first[own] + o, g.first[own] + o)
    starts, docs, hashes = g.hot_strings(np.flatnonzero(split))
    if len(starts):
        _, least = _least(docs, hashes)
        own = starts[(docs > least) | _within(_key(docs, hashes), tags)]
        cover(own, own)
    gone = np.cumsum(start[:-1]) > 0
    rows = []
    for i, (a, b) in enumerate(zip(g.starts.tolist(), g.ends.tolist())):
        cut = gone[a:b]
        kept = g.raw[a:b][~cut].tobytes()
        spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
        rows.append((g.ids[i], b - a, int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] * with_text)))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + with_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, list(zip(*rows)) or [()] * len(names), kinds)})


def remove_repeats(docs: DataFrame, with_text: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, in bytes) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), safe_text(F.col("text")).cast("binary").alias("raw"))
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    groups = max(8, size // group_bytes)
    buckets = max(8, size // (16 << 20))
    # one exchange of the texts, which all three steps below read; dealt by a row's place, as any id may have very many rows
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")).repartition(groups, "grp")
    windows = dealt.groupBy("grp").applyInArrow(lambda t: send_windows(t, buckets), ROWS)
    verdicts = windows.groupBy("bucket").applyInArrow(judge_windows, ROWS)
    strings = dealt.groupBy("grp").cogroup(verdicts.groupBy("grp")).applyInArrow(lambda t, v: send_strings(t, v, 4 * buckets), ROWS)
    answers = strings.groupBy("bucket").applyInArrow(judge_strings, ROWS)

    def finish(t: pa.Table, v: pa.Table) -> pa.Table:
        return settle(t, v, with_text)

    return dealt.groupBy("grp").cogroup(verdicts.unionByName(answers).groupBy("grp")).applyInArrow(finish, SPANS + ", kept_text binary" * with_text)
