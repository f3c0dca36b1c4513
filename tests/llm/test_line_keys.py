"""Packing of band keys, and the choice of a line's kind of signature, against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import line_dedup as ld


def expected(rows):
    """The (id, key) of keys that several ids have."""
    ids = defaultdict(set)
    for key, i, _ in rows.tolist():
        ids[key].add(i)
    return {(i, key) for key, found in ids.items() if len(found) > 1 for i in found}


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_shared_keys_with_a_key_of_a_third_of_all_rows(parts):
    rng = np.random.default_rng(parts)
    rows = np.stack([rng.integers(-400, 400, 3000), rng.integers(0, 900, 3000), np.zeros(3000, np.int64)], axis=1)
    rows[:1000, 0] = 7
    rows[1000:1200] = [-5000, 3, 0]  # one line that many tasks met: no other id, nothing to link
    rows = rows[rng.permutation(len(rows))]
    known, out = ld._NONE, []
    for part in np.array_split(rows, parts):
        known, batches = ld._shared(known, [*np.array_split(part, 3)])
        out += [pair for b in batches for pair in zip(b["id"].to_pylist(), b["key"].to_pylist(), strict=True)]
    assert set(out) == expected(rows)
    assert len(known[0]) == len(set(rows[:, 0].tolist()))  # one row a key is kept, however many share it


def test_shared_keys_of_nothing():
    assert ld._shared(ld._NONE, []) == (ld._NONE, [])


def test_packed_rows_come_back_by_bucket():
    rng = np.random.default_rng(1)
    rows = rng.integers(-(2**63), 2**63 - 1, (500, 3))
    rows[0, 0], rows[1, 0] = -(2**63), 2**63 - 1
    batch = ld._packed(rows, 16)
    back = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for x in batch["rows"]])
    assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, rows.tolist()))
    buckets = batch["bucket"].to_pylist()
    assert buckets == sorted(set(buckets)) and 0 <= buckets[0] and buckets[-1] < 16


@pytest.mark.parametrize("span", [5, 9])
def test_kind_of_signature_from_the_first_spans(span):
    rng = np.random.default_rng(span)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    lines = ["a", "abcd", "ab" * 500, "x" * 3000, word(131), word(140), word(170), word(400), word(100) * 9, word(150) * 9, "q" * 400 + word(600)]
    for line, got in zip(lines, ld._distinct_spans(lines, span).tolist(), strict=True):
        spans = max(1, len(line) - span + 1)
        true = len({line[i : i + span] for i in range(spans)})
        if spans < ld.ONE:  # too few spans for a long line, whatever they are
            assert got == spans
        else:
            assert got == true or min(got, true) >= ld.MANY
