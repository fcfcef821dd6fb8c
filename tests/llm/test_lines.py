import hashlib

import numpy as np
from frames import collected, empty, frame, odd_documents

from cohortdeck.llm import lines
from cohortdeck.llm.lines import dedup_lines, filter_bits, line_key


def by_hand(rows):
    """(doc_id, text) -> kept text, lines, dropped."""
    holders = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            if len(key) >= 10:
                holders.setdefault(key, set()).add(-(1 << 63) if doc_id is None else doc_id)
    out = []
    for doc_id, text, *_ in rows:
        own = -(1 << 63) if doc_id is None else doc_id
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line_key(line.encode()).decode()
            if len(key) < 10 or len(holders[key]) < 2 or min(holders[key]) == own:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_documents(spark):
    found = dedup_lines(frame(spark, extra=True))
    assert found.columns[: len(frame(spark, extra=True).columns)] == frame(spark, extra=True).columns
    rows = [(r.doc_id, r["__n_lines"], r["__n_dropped"], hashlib.sha256(r.text.encode()).hexdigest()) for r in found.collect()]
    assert sorted(rows, key=str) == by_hand(odd_documents())


def test_full_filter_changes_nothing(spark, monkeypatch):
    """A filter far too small suspects every line, and the result stays exact."""
    want = collected(dedup_lines(frame(spark)))
    monkeypatch.setattr(lines, "repeat_filter", lambda docs, least, bits, hashes: np.full(bits // 8, 255, np.uint8))
    assert collected(dedup_lines(frame(spark))) == want
    assert filter_bits(10**12, 128, 1 << 28) == 1 << 28


def test_hot_line(spark):
    rows = [(k, f"the line that everybody has\nown line number {k:06d}", "en", "a", 1) for k in range(3000)]
    found = dedup_lines(frame(spark, rows).repartition(16)).groupBy("__n_dropped").count()
    assert collected(found) == [(0, 1), (1, 2999)]


def test_empty_table(spark):
    assert dedup_lines(empty(spark)).collect() == []
