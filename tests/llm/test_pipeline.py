"""The pipeline's stages, each on its own input, against versions in plain Python."""

import collections
import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from blockloom.llm import linededup, mixing, quality
from blockloom.llm.common import materialise, read

from .test_methods import brute_mcd
from .test_operators import brute_fingerprint, brute_statistics, check_packing, sentence

SF = "/root/testdata/sf0.001"
SHARED = "Read more on the pages of the planted sites"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def planted():
    """Lines that twelve sites share, edits of one text, symbols, repeats, nulls."""
    rng, rows = random.Random(8), []
    for k in range(12):
        rows.append((f"{sentence(k, 60)}\n{SHARED}\n{sentence(k + 500, 60)}", f"site{k}"))
    base = [f"v{rng.randrange(10**4)}" for _ in range(150)]
    for k in range(8):
        edit = list(base)
        for _ in range(k % 4):
            edit[rng.randrange(150)] = f"n{rng.randrange(10**4)}"
        rows.append((" ".join(edit), f"site{k}"))
    rows += [("# $ % & | < > * " * 40 + sentence(9), "site1"), ("spam eggs " * 60, "site2"), (None, "site3"), ("", None), (rows[0][0], None)]
    return [(10**6 + k, t, "en", s, len(t or "")) for k, (t, s) in enumerate(rows)]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before each stage and after the last."""
    docs = read(spark, SF, "documents")
    now, seen = docs.unionByName(spark.createDataFrame(planted(), docs.schema)), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(now.collect())
        out = materialise(stage(spark, now, SF), f"test{k}")
        assert k == 4 or out.columns == docs.columns
        now = out
    return [*seen, now.collect()]


def test_quality_stage(stages):
    rows, far = stages[0], {}
    vectors, pools = {}, collections.defaultdict(list)
    for r in rows:
        words, chars, symbols, lines, repeats = brute_statistics(r.text)
        if words >= 10 and 100 * repeats <= 20 * words:
            n = words + quality.PRIOR_WORDS
            vectors[r.doc_id] = [math.log1p(symbols / n), math.log((chars + quality.PRIOR_WORDS * quality.PRIOR_WORD_CHARS) / n), repeats / n, lines / n]
            pools[r.lang, r.source].append(r.doc_id)
    for depth in (1, 0):  # small groups go to their language, small languages together
        for name in [g for g, ids in pools.items() if len(g) == depth + 1 and len(ids) < quality.MIN_ROWS]:
            pools[name[:depth]] += pools.pop(name)
    assert len(pools) > 2
    for name, ids in pools.items():
        fitted = ids if len(ids) >= quality.MIN_ROWS else list(vectors)
        best, s, n, floors = brute_mcd(np.array([vectors[i] for i in fitted]))
        c = np.linalg.cholesky(s * (1 + quality.SMALL * quality.H_SHARE / n) + np.diag(floors**2))
        z = np.linalg.solve(c, (np.array([vectors[i] for i in ids]) - best[1]).T)
        far |= dict(zip(ids, (z * z).sum(axis=0)))
    kept = {r.doc_id for r in stages[1]}
    assert kept < {r.doc_id for r in rows}
    clear = [r.doc_id for r in rows if abs(far.get(r.doc_id, 0) - quality.CUTOFF) > 0.03 * quality.CUTOFF]
    assert len(clear) > 0.97 * len(rows)
    assert [i in kept for i in clear] == [i in far and bool(far[i] <= quality.CUTOFF) for i in clear]
    assert {r for r in stages[1]} <= set(rows)


def test_line_stage(stages):
    rows = stages[1]
    sites, first = collections.defaultdict(set), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        for line in (r.text or "").split("\n"):
            if key := line.strip(linededup.BLANK):
                sites[key] |= {r.source} - {None}
                first.setdefault(key, r.doc_id)
    drop = {k: first[k] for k, s in sites.items() if len(s) >= linededup.MIN_SITES}
    assert SHARED in drop
    want = {}
    for r in rows:
        lines = None if r.text is None else [x for x in r.text.split("\n") if drop.get(x.strip(linededup.BLANK), r.doc_id) == r.doc_id]
        text = None if lines is None else "\n".join(lines)
        want[r.doc_id] = (text, r.lang, r.source, len(text or "") if text != r.text else r.n_chars)
    assert {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in stages[2]} == want
    assert len(stages[2]) == len(rows)


def test_near_duplicate_stage(stages):
    """No two kept texts are linked; each one that goes is linked, over others, to one kept."""
    texts = {r.doc_id: r.text for r in stages[2]}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, links = sorted(texts), collections.defaultdict(set)
    for a in ids:
        for b in ids:
            if a < b and ((fps[a] ^ fps[b]).bit_count() <= 2 or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                links[a].add(b)
                links[b].add(a)
    kept = {r.doc_id for r in stages[3]}
    assert len(kept) == len(stages[3]) < len(ids) and {r for r in stages[3]} <= set(stages[2])
    assert not [(a, b) for a in kept for b in links[a] & kept]
    reached, todo = set(kept), list(kept)
    while todo:
        new = links[todo.pop()] - reached
        reached |= new
        todo += new
    assert reached == set(ids)


def brute_topic(text):
    t, n = text or "", len(text or "")
    if re.search(mixing.NOTICE, t.lower()):
        return "notice"
    for least, pattern, name in ((20, mixing.SYMBOLS, "markup"), (20, "[0-9]", "figures"), (80, "\n", "list")):
        if least * len(re.findall(pattern, t)) > n:
            return name
    return "short" if n < 500 else "article" if n < 4000 else "long"


def brute_probabilities(cells, temper):
    """Raked probabilities of cells (margins: tokens), and the largest gap that is left."""
    total, targets = sum(cells.values()), []
    for m in range(3):
        own = collections.Counter()
        for cell, n in cells.items():
            own[cell[m]] += n
        share, full = {v: n**temper for v, n in own.items()}, set()
        while True:  # what is asked of full values goes to the others
            left = mixing.KEEP * total - sum(mixing.RESERVE * own[v] for v in full)
            level = left / sum(w for v, w in share.items() if v not in full)
            over = {v for v in own if v not in full and share[v] * level > mixing.RESERVE * own[v]}
            if not over:
                break
            full |= over
        targets.append({v: mixing.RESERVE * own[v] if v in full else share[v] * level for v in own})
    p, gap = dict.fromkeys(cells, mixing.KEEP), 1.0
    for _ in range(240):
        for m in range(3):
            had = collections.Counter()
            for cell, n in cells.items():
                had[cell[m]] += p[cell] * n
            p = {c: min(1.0, x * targets[m][c[m]] / had[c[m]]) for c, x in p.items()}
        sums = [sum(p[c] * n for c, n in cells.items() if c[m] == v) - t for m in range(3) for v, t in targets[m].items()]
        wanted = [t for m in range(3) for t in targets[m].values()]
        gap = max(abs(s) / max(1, t) for s, t in zip(sums, wanted))
        if gap <= mixing.STEADY:
            break
    return p, gap


def test_mixing_stage(stages):
    of = {r.doc_id: (r.source or mixing.NONE, r.lang or mixing.NONE, brute_topic(r.text)) for r in stages[3]}
    cells = collections.Counter()
    for r in stages[3]:
        cells[of[r.doc_id]] += max(1, math.ceil(len(r.text or "") / 4))
    for temper in (mixing.TEMPER, 0.925, 0.9625, 0.98125, 1.0):
        p, gap = brute_probabilities(cells, temper)
        if gap <= mixing.AGREE:
            break
    assert gap <= mixing.AGREE
    numbers = {i: int(hashlib.md5(f"{i}|mix".encode()).hexdigest()[:13], 16) / (1 << 52) for i in of}
    kept = {r.doc_id for r in stages[4]}
    assert kept and {r for r in stages[4]} < set(stages[3])
    clear = [i for i in of if abs(numbers[i] - p[of[i]]) > 1e-4]
    assert [i in kept for i in clear] == [numbers[i] < p[of[i]] for i in clear]


def test_packing_stage(stages):
    check_packing([(r.doc_id, r.text) for r in stages[4]], stages[5])
