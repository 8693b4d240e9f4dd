"""Filter audit, Merkle manifest and license scan beside brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import filter_audit, license_scan, merkle_manifest
from stratalens.llm.queries import TAMPERED

from .shapes import awkward, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed_filters(rows):
    """Letters of the filters that every (id, part, text) fails, text by text."""
    first: dict[str, int] = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, _, t in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        out.append(fails + "E" * (i is not None and first[t] < i))
    return out


def walked(rows, labels):
    """The audit by walking every document through every order."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    out = defaultdict(lambda: [0] * 6)
    fails = failed_filters(rows)
    for order in map("".join, itertools.permutations("ABCDE")):
        for (i, part, _), failed in zip(rows, fails, strict=True):
            gone = False
            for step, letter in enumerate(order, 1):
                cell = out[part or "", order, step]
                if letter in failed:
                    cell[3] += failed == letter
                    if gone:
                        cell[2] += 1
                    else:
                        cell[1] += 1
                        cell[4] += i in good
                        cell[5] += i in toxic
                        gone = True
                cell[0] += not gone
    shares = Counter()
    for (part, order, step), cell in out.items():
        shares[part, order[step - 1]] += cell[1]
    return {(*k, *cell, shares[k[0], k[1][k[2] - 1]]) for k, cell in out.items()}


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(5)
    texts = [*awkward(), *((100 + i, prose(i % 40, 40 + i % 30)) for i in range(120)), *((300 + i, prose(500 + i, 60).upper() if i % 2 else prose(i, 60) + " #") for i in range(20))]
    parts = [rng.choice(["a", "b", None, "", "ü"]) for _ in texts]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _ in texts[::2]] + [(1, 1, 0), (1, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return texts, parts, labels


def with_parts(spark, texts, parts):
    docs = documents(spark, texts)
    return spark.createDataFrame([(*r[:3], p, *r[4:]) for r, p in zip(docs.collect(), parts, strict=True)], docs.schema)


@pytest.mark.parametrize("hot", [1, 1000])
def test_audit_against_walking_every_order(spark, audited, monkeypatch, hot):
    texts, parts, labels = audited
    monkeypatch.setattr(filter_audit, "HOT", hot)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    words = filter_audit.survival_words(with_parts(spark, texts, parts), marks)
    got = {tuple(r) for r in filter_audit.audit(filter_audit.survivors(words)).collect()}
    rows = [(i, p, t) for (i, t), p in zip(texts, parts, strict=True)]
    known = [x for x in labels if x[0] is not None]
    assert got == walked(rows, known)
    assert len(got) == 600 * len({p or "" for p in parts})


def test_audit_of_an_empty_table(spark, audited):
    texts, _, labels = audited
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    words = filter_audit.survival_words(documents(spark, texts).limit(0), marks)
    assert filter_audit.audit(filter_audit.survivors(words)).collect() == []


def test_carry_save_counts_in_any_pieces():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32)
    want = [(words >> np.uint32(s) & np.uint32(1)).sum() for s in range(32)]
    assert filter_audit.counts(filter_audit.added(words, [])) == want
    planes: list[int] = []
    for piece in np.split(words, [0, 1, 3, 500, 501, 4000]):
        planes = filter_audit.added(piece, planes)
    assert filter_audit.counts(planes) == want and len(planes) <= 14


def digest(*hexes):
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def row_digest(row, more=0):
    doc_id, text, _, source, n_chars, lang = (*row[:5], row[2])
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proved(leaves):
    """(root, siblings of every leaf with their side) of a list of digests, by whole levels."""
    level, at = list(leaves), list(range(len(leaves)))
    paths = [[] for _ in leaves]
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append((i % 2, level[i ^ 1]) if i ^ 1 < len(level) else None)
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def expected_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, row_digest(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: proved([g[2] for g in sorted(groups[x], key=lambda g: g[:3])]) for x in names}
    root, above = proved([trees[x][0] for x in names])
    out = Counter()
    for name, upper in zip(names, above, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[name], key=lambda g: g[:3]), trees[name][1], strict=True):
            steps = path + upper
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % TAMPERED == 0
            now = row_digest(r, 1) if tampered else leaf
            for s in steps:
                now = digest(now) if s is None else digest(s[1], now) if s[0] else digest(now, s[1])
            out[r[0], leaf, trees[name][0], root, digest(*(s[1] for s in steps if s)), now] += 1
    return out


def manifest_of(docs, levels):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    changed = merkle_manifest.digest_of([docs[c] + 1 if c == "n_chars" else docs[c] for c in merkle_manifest.COLUMNS])
    found = merkle_manifest.manifest(docs, changes={"changed": F.when(hit, changed)}, levels=levels)
    fold = merkle_manifest.folded(F.coalesce("changed", "leaf"), F.col("proof"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")), fold)


@pytest.mark.parametrize("levels", [1, 3, 12])
def test_manifest_against_whole_levels(spark, levels):
    texts = [*awkward(), *((20 + i, prose(i, 5)) for i in range(60))]
    docs = documents(spark, texts)
    langs = [None, "en", "de", "en", "", "fr", "en", "é", "en", "zz"]
    rows = [(*r[:2], langs[i % len(langs)] if i != 3 else "one", *r[3:]) for i, r in enumerate(docs.collect())]
    docs = spark.createDataFrame(rows, docs.schema)
    assert Counter(tuple(r) for r in manifest_of(docs, levels).collect()) == expected_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17])
def test_manifest_of_one_part(spark, n):
    docs = documents(spark, [(i, prose(i, 3)) for i in range(n)])
    rows = [tuple(r) for r in docs.collect()]
    assert Counter(tuple(r) for r in manifest_of(docs, 2).collect()) == (expected_manifest(rows) if n else Counter())


def test_proofs_catch_any_other_row(spark):
    docs = documents(spark, [(i, prose(i, 3)) for i in range(9)])
    found = merkle_manifest.manifest(docs).collect()
    for r in found:
        for other in found:
            now = other.leaf
            for s in r.proof:
                now = digest(now) if s[0] == "-" else digest(s[1:], now) if s[0] == "L" else digest(now, s[1:])
            assert (now == r.root) == (other.doc_id == r.doc_id)


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def places(text):
    w = words_of(text)
    found = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_phrases_of_awkward_texts(spark):
    notices = [
        "Released under the MIT License.", "UNDER the\nmit-License; under the mit license", "cc by nc cc by-nc CC.BY.NC-SA 4.0", "Apache License, Version 2.0 apache license version 20",
        "xunder the mit license", "under the mit licensé", "under the mit license", "ünder the mit license under THE mit license", "cc by nc", "by nc cc by", "cc\x1cby\x7fnc", "K cc by nc 文",
        prose(1, 30_000) + " under the mit license " + prose(2, 10) + " cc by nc",
    ]
    texts = [*awkward(), *enumerate(notices, 50), *((80 + i, prose(i, 40) + notices[i % len(notices)] * (i % 3)) for i in range(40))]
    rows = license_scan.scan(documents(spark, texts)).collect()
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    assert got == Counter((i, *places(t)) for i, t in texts)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert all(r.labels == ",".join(sorted(set(r.labels.split(",")))) for r in rows)
    assert license_scan.scan(documents(spark, texts).limit(0)).collect() == []


def by_descent(tokens):
    """(licences, freedom) by recursive descent, or None."""
    at = 0

    def level(i):
        nonlocal at
        if i == 3:
            if at < len(tokens) and tokens[at] == "(":
                at += 1
                value = level(0)
                if at >= len(tokens) or tokens[at] != ")":
                    raise ValueError
                at += 1
                return value, True
            if at >= len(tokens) or tokens[at] in ("and", "or", "with", ")"):
                raise ValueError
            at += 1
            label = license_scan.label_of(tokens[at - 1])
            return (frozenset([label]), license_scan.FREEDOM.get(label, 0.0)), False
        operator = ("or", "and", "with")[i]
        value, grouped = level(i + 1) if i < 2 else level(3)
        while at < len(tokens) and tokens[at] == operator:
            at += 1
            right, other = level(i + 1) if i < 2 else level(3)
            if operator == "with":
                if grouped or other:
                    raise ValueError
                value = (value[0], (value[1] + 1) / 2)
            else:
                value = (value[0] | right[0], (max if operator == "or" else min)(value[1], right[1]))
            grouped = False
        return (value, grouped) if i else value

    try:
        out = level(0)
    except ValueError:
        return None
    return out if at == len(tokens) else None


def test_expressions_against_recursive_descent():
    rng = random.Random(2)
    seen = Counter()
    for _ in range(20_000):
        tokens = rng.choices(["mit", "gpl-3.0-only", "cc-by-nc-4.0", "odd", "and", "or", "with", "(", ")"], k=rng.randint(1, 9), weights=[3, 3, 2, 1, 3, 3, 1, 2, 2])
        want, got = by_descent(tokens), license_scan.evaluated(tokens)
        assert (want is None) == (got is None), tokens
        seen[want is None] += 1
        if got is not None:
            assert (frozenset(got.licences), got.freedom) == want, tokens
            again = license_scan.evaluated(re.findall(r"[()]|[^\s()]+", got.text))
            assert again is not None and (again.licences, again.freedom) == (got.licences, got.freedom) or "odd" in tokens or "with" in tokens
        n = license_scan.complete(tokens)
        assert n == max((k for k in range(len(tokens) + 1) if k == 0 or by_descent(tokens[:k])), default=0), tokens
    assert min(seen.values()) > 500


@pytest.mark.parametrize(
    ("text", "labels", "freedom"),
    [
        ("// SPDX-License-Identifier: MIT", "mit", 0.9),
        ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only */", "apache-2,gpl-2,mit", 0.4),
        ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR LicenseRef-own", "gpl-2,licenseref-own", 0.7),
        ('"license": "BSD-3-Clause",', "bsd-3", 0.9),
        ("License: see the file for the terms", "", None),
        ("license: mit and see the rest", "mit", 0.9),
        ("licence: (mit", "", None),
        ("SPDX-License-Identifier: and or", "", None),
        ("SPDX-License-Identifier:\nMIT", "", None),
        ("cc by nc sa", "cc-by-nc,cc-by-nc-sa", 0.1),
        ("creative commons attribution noncommercial", "cc-by-nc", 0.1),
        ("GNU General Public License, version 3", "gpl-3", 0.4),
    ],
)
def test_tags_and_notices(text, labels, freedom):
    row = license_scan.Scanner().scan(text.encode()).row()
    assert row[5] == labels and row[8] == freedom
    assert (row[6] > 0) == bool(labels)


@pytest.mark.parametrize("text", ["license: " * 30_000, "license: " + "(" * 200_000, "license: " + "mit or " * 60_000 + "mit", "license: " + "(mit or " * 50_000 + "mit" + ")" * 50_000, "cc by nc " * 40_000, "license: " + "mit " * 100_000])
def test_long_texts_take_no_square(text):
    start = time.perf_counter()
    license_scan.Scanner().scan(text.encode()).row()
    assert time.perf_counter() - start < 5
