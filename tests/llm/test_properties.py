"""Properties of the in-memory parts."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontaminate, simhash, suffix_dedup, token_store


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    k = np.array(sorted(keys), np.int64).view(np.uint64)
    assert sorted(token_store.PerfectHash.build(k).slots(k).tolist()) == list(range(len(k)))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 12) - 1), min_size=2, max_size=60), st.integers(1, 3))
def test_bucket_links_join_all_chains(words, radius):
    members = sorted(words)
    root = {m: m for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(members):
        for b in members[:i]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    made = {m: m for m in members}

    def find2(x):
        while made[x] != x:
            x = made[x]
        return x

    links = list(simhash.bucket_links(members, list(range(12)), radius))
    for a, near, b in ((members[r], members[n], members[i]) for r, n, i in links):
        assert (near ^ b).bit_count() <= radius
        made[max(find2(a), find2(b))] = min(find2(a), find2(b))
    assert len(links) < len(members) and {m: find2(m) for m in members} == {m: find(m) for m in members}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab", max_size=12), st.text(alphabet="ab", max_size=13))
def test_one_edit(p, t):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    assert decontaminate.one_edit(p, t) == any(distance(p, t[:n]) <= 1 for n in range(len(t) + 1))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(20, 200))
def test_chunks_cover_every_suffix_once(raw, stretch):
    c = suffix_dedup.Chunks(np.frombuffer(raw, np.uint8), stretch)
    starts = [s for a, b in zip(c.first.tolist(), c.last.tolist(), strict=True) for s in range(a, b + 1)]
    assert starts == list(range(max(0, len(raw) - suffix_dedup.DEPTH + 1))) and all(b - a < suffix_dedup.DEPTH for a, b in zip(c.first, c.last, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1 << 40), st.integers(0, 1 << 31)), max_size=50).map(sorted))
def test_blobs_round_trip(rows):
    doc, number = (np.array([r[i] for r in rows], t) for i, t in ((0, np.int64), (1, np.uint32)))
    blob = suffix_dedup.packed(doc, doc * 3, [(number, True), (number + np.uint32(1), False)], b"tail" * len(rows))
    (a, b, c, e), tail = suffix_dedup.unpacked(blob, [("<u4", True), ("<u4", False)])
    assert a.tolist() == doc.tolist() and b.tolist() == (doc * 3).tolist() and c.tolist() == number.tolist() and e.tolist() == (number + np.uint32(1)).tolist() and tail == b"tail" * len(rows)
