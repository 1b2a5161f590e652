"""Conversation repair, spelling variants and the n-gram join against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapwright.llm import conversation, ngram_join, spelling
from tests.llm.test_corpus import SCHEMA, near_rows, odd_rows, shingles, words

LOWER = {a: a + 32 for a in range(65, 91)}
def brute_repair(rows):
    """rows: (conv, turn, role, text)"""
    by=collections.OrderedDict()
    for c,t,r,x in rows:
        g=by.setdefault(c,[])
        r=" " if r is None else r; x=" " if x is None else x
        k=zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode())%20
        if k==0: continue
        if k==1: x=""
        if k==2: x=re.sub("[.!?]","",x)
        if k==4: r="user"
        g.extend([(t,r,x)]*(2 if k==3 else 1))
    out={}
    for c,g in by.items():
        g.sort(key=lambda z:(z[0] is not None, z[0] or 0, z[1].encode(), hashlib.md5(z[2].encode()).digest()))
        seen=set(); codes=[]
        for t,r,x in g:
            s=x.strip(" \t\n\x0b\x0c\r")
            f="b" if not s else "d" if (r,x) in seen else "t" if s[-1] not in ".!?" else ""
            seen.add((r,x)); codes.append(f)
        nxt={0:2,1:2,2:3,3:2}; name={2:"user",3:"assistant"}
        ok={(0,"s"):1,(0,"u"):2,(1,"u"):2,(2,"a"):3,(3,"u"):2}
        n=len(g)
        best={}
        for i in range(n,-1,-1):
            def opts(q):
                o=[]
                if i==n and q in (0,3): o.append((0,"",()))
                if i<n:
                    c_,a_,l_=best[i+1,q]; o.append((c_+4,"D"+a_,l_))
                    t,r,x=g[i]; f=codes[i]
                    if f not in ("b","d"):
                        e=3 if f=="t" else 0
                        k=ok.get((q,r[:1]))
                        if k is not None:
                            c_,a_,l_=best[i+1,k]; o.append((c_+e,"K"+a_,(f"{r}:{x}",)+l_))
                        c_,a_,l_=best[i+1,nxt[q]]; o.append((c_+e+3,"R"+a_,(f"{name[nxt[q]]}:{x}",)+l_))
                return o
            cur={q:min(opts(q),default=(10**9,"",())) for q in range(4)}
            for _ in range(3):
                for q in range(4):
                    c_,a_,l_=cur[nxt[q]]
                    cur[q]=min(cur[q],(c_+3,"I"+a_,(f"{name[nxt[q]]}:",)+l_))
            for q in range(4): best[i,q]=cur[q]
        cost,audit,lines=best[0,0]
        ts=[t for t,_,_ in g if t is not None]
        ini=[r[:1] for _,r,_ in g]
        out[c]=(c,max(ts)-min(ts)+1-len(set(ts)) if ts else 0,codes.count("b"),codes.count("d"),codes.count("t"),sum(a+b not in("su","ua","au") for a,b in zip(ini,ini[1:])),cost,audit,hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk_rows():
    r = random.Random(12)
    texts = ["Fine.", "no end", "", " \t\n", "Fine.", "What?", "Go! ", "x" * 5000 + "."]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", "tool", "", None]) if r.random() < 0.4 else ("user", "assistant")[t % 2], r.choice(texts))
            for c in range(60) for t in range(r.randint(1, 9))]
    rows += [(90, t, ("user", "assistant")[t % 2], f"turn {t}" + ("." if t % 5 else "")) for t in range(1500) if t % 11]      # many blocks
    rows += [(91, None, "user", "null turn."), (91, None, "user", "null turn."), (91, 4, "user", None), (91, 4, "assistant", "a."), (91, 4, "assistant", "b."),
             (None, 1, "user", "no id."), (None, 2, None, None), (92, 7, "user", "hi."), (92, 7, "user", "hi.")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "gone.")], dropped


def test_repair_matches_brute_force(spark):
    rows, dropped = talk_rows()
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, pos int").repartition(5)
    got = {r[0]: tuple(r) for r in conversation.repaired(d).collect()}
    want = brute_repair(rows)
    empty = (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got.pop(dropped) == empty and got == {k: v for k, v in want.items() if k != dropped}
    assert conversation.repaired(d.limit(0)).count() == 0


def test_repaired_roles_are_legal_and_cheapest():
    r = random.Random(4)
    for _ in range(120):
        codes = bytes(4 * r.randrange(4) + r.choice([0, 0, 0, 1, 2, 3]) for _ in range(r.randint(1, 5)))
        (_, edits), *_ = [conversation._walk(codes, list(conversation.END))[0]]
        best = None
        for ops in itertools.product(*[["D", "K", "R"]] * len(codes)):          # inserts are filled in by the shortest legal completion
            frontier = {0: 0}
            for c, e in zip(codes, ops):
                reach = dict(frontier)
                for _ in range(3):
                    for q, k in list(reach.items()):
                        reach[conversation.NEXT[q]] = min(reach.get(conversation.NEXT[q], 99), k + 3)
                frontier = {}
                for q, k in reach.items():
                    extra = 3 if c & 3 == 1 else 0
                    if e == "D":
                        to, k = q, k + 4
                    elif c & 3 > 1:
                        continue
                    elif e == "K":
                        to, k = conversation._after(c, q), k + extra
                    else:
                        to, k = conversation.NEXT[q], k + 3 + extra
                    if to >= 0:
                        frontier[to] = min(frontier.get(to, 99), k)
            ends = [k + conversation.END[q] for q, k in frontier.items()]
            best = min([*ends, *([best] if best is not None else [])], default=None)
        costs = list(conversation.END)
        for c in reversed(codes):
            costs = conversation._step(c, costs)
        assert costs[0] == best
        assert re.fullmatch("[DIKR]*", edits)


def brute_words(rows, every=199):
    count = collections.Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(rows):
    v = brute_words(rows)
    near = {w: [x for x in v if x != w and one_edit(x, w)] for w in v}
    form = {w: min(near[w], key=lambda x: (-v[x], x)) for w in v if near[w]}
    form = {w: f for w, f in form.items() if v[f] >= 5 * v[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n, len(near[w]), v[form[w]] if w in form else None) for w, n in v.items()}


def word_rows():
    r = random.Random(9)
    base = ["abcdef", "abcdefg", "aaaaaa", "aaaaaaa", "aaaaaaaa", "élément", "elément", "Straße", "q" * 700, "q" * 701, "q" * 300 + "z" + "q" * 400]
    base += ["".join(r.choice("ab") for _ in range(7)) for _ in range(40)]
    times = {w: 5 * 6 ** r.randrange(4) for w in base}
    flat = [w for w, n in times.items() for _ in range(n)]
    r.shuffle(flat)
    return [(i, " ".join(x.upper() if r.random() < 0.1 else x for x in flat[i::40])) for i in range(40)] + [(None, "abcdef " * 9), (None, None), (7, ""), (7, "x")]


@pytest.mark.parametrize("limit", [20_000, 4])
def test_variants_match_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(spelling.near_summary, "__defaults__", (spelling.MIN_CHARS, limit))
    rows = word_rows()
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, word string, n int").repartition(4)
    got = [tuple(r) for r in spelling.variants(d).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(rows)
    assert spelling.variants(d.limit(0)).count() == 0


def test_near_words_come_once():
    vocab = sorted({"".join(p) for k in (3, 4) for p in itertools.product("ab", repeat=k)} | {"abab", "bbab"})
    a = spelling.Acceptor(vocab)
    assert len(a.arcs) - len({t for arcs in a.arcs for t in arcs.values()}) > 0          # merged states are left behind
    pairs = list(spelling.near_words(a, a))
    assert len(pairs) == len(set(pairs))
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in itertools.combinations(vocab, 2) if one_edit(*p)}


def brute_join(rows, percent=80):
    sets = collections.defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            sets[i].append(shingles(t))
    comp = {i: i for i in sets}
    for _ in sets:
        before = dict(comp)
        for i, j in itertools.combinations(sets, 2):
            if comp[i] != comp[j] and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                low, high = sorted((comp[i], comp[j]))
                comp = {k: low if c == high else c for k, c in comp.items()}
        if comp == before:
            return comp
    return comp


def long_rows():
    r = random.Random(17)
    base = words(2600, 70).split()
    rows = [(200, " ".join(base))]
    for k in range(201, 209):
        w = list(base)
        for _ in range(20 * (k - 200)):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        rows.append((k, " ".join(w)))
    short = [(300 + k, " ".join(words(9, 80).split()[:9 - k % 4] + [f"e{k // 4}"] * (k // 4))) for k in range(16)]
    return near_rows() + rows + short


@pytest.mark.parametrize("rows, few", [(long_rows, 64), (long_rows, 0), (odd_rows, 64)])
def test_join_matches_brute_force(spark, rows, few, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", few)      # 0: every member with partners goes the way of crowded ones
    rows = rows()
    d = spark.createDataFrame([tuple(r) + (None,) * (7 - len(r)) for r in rows], SCHEMA).withColumnRenamed("shard", "node").repartition(5)
    got = ngram_join.join_documents(d).collect()
    want = brute_join(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items()) and len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((r[0], len(shingles(r[1]))) for r in rows)
    assert ngram_join.join_documents(d.limit(0)).count() == 0


def test_short_sets_bound_the_overlap_and_spare_the_full_ones():
    """op13: pairs are judged by 16 bits a shingle first, which never lose a link and leave hardly any pair below the similarity."""
    r = np.random.default_rng(5)
    sets, kept = [], []
    for k in range(120):
        a = np.unique(r.integers(0, 2 ** 64, int(r.integers(1, 1500)), dtype=np.uint64))
        if k % 4 == 0:
            a = np.unique(a % np.uint64(2 ** 50))                # many equal top bits
        b = np.unique(np.concatenate([r.permutation(a)[len(a) * int(r.integers(0, 40)) // 100:], r.integers(0, 2 ** 64, len(a) // 20, dtype=np.uint64)]))
        sets.append((a, b) if len(b) else (a, a))
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array([1000 + k for k in range(120)]),
                                        *[pa.array([ngram_join.short(p[side]).tobytes() for p in sets], pa.binary()) for side in (0, 1)]],
                                       ["a", "b", "short_a", "short_b"])
    for out in ngram_join._likely(80)([batch]):
        kept += out.column("a").to_pylist()
    linked = [k for k, (a, b) in enumerate(sets) if ngram_join.allowed(ngram_join.shared_count(a, b), len(a), len(b), 80)]
    assert set(linked) <= set(kept) and 0 < len(linked) < 100
    assert len([k for k in kept if k % 4]) <= len([k for k in linked if k % 4]) + 3


def test_only_wanted_texts_reach_the_join(spark):
    """op13: the sieve below the join by id lets all wanted rows through and few others."""
    docs = spark.range(-5000, 5000).select(F.col("id").alias("__id"), F.lit("x").alias("__text"))
    wanted = docs.where("__id % 50 = 0").select("__id")
    passed = {r[0] for r in ngram_join._sieved(docs, wanted, "__id").select("__id").collect()}
    assert {r[0] for r in wanted.collect()} <= passed and len(passed) < 300
    assert ngram_join._sieved(docs, wanted.limit(0), "__id").count() == 0


def test_linked_sets_share_a_token_and_the_tree_loses_none():
    r = np.random.default_rng(3)
    with np.errstate(over="ignore"):
        for n in (1, 4, 5, 9, 20, 63, 64, 80, 150, 700, 1100, 3000):
            for _ in range(20):
                a = np.unique(r.integers(0, 2 ** 64, n, dtype=np.uint64))
                gone = r.integers(0, n // 9 + 1)
                b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 2 ** 64, r.integers(0, n // 9 + 1), dtype=np.uint64)]))
                both = ngram_join.shared_count(a, b)
                if len(b) and ngram_join.allowed(both, len(a), len(b), 80):
                    assert np.intersect1d(ngram_join.tokens(a, 80), ngram_join.tokens(b, 80)).size
        sets = [np.unique(r.integers(0, 2 ** 64, r.integers(20, 60), dtype=np.uint64)) for _ in range(300)]
        points = np.stack([ngram_join.folded(ngram_join.point(s), ngram_join.GROUPS) for s in sets])
        sizes = np.array([len(s) for s in sets])
        tree = ngram_join.Tree(points, sizes)
        for k in range(0, 300, 7):
            want = np.flatnonzero(ngram_join.allowed(np.minimum(points, points[k]).sum(axis=1), sizes, sizes[k], 80)
                                  & (100 * np.minimum(sizes, sizes[k]) >= 80 * np.maximum(sizes, sizes[k])))
            found = [y for _, place in tree.search(points[k:k + 1], sizes[k:k + 1], 80) for y in place.tolist()]
            assert sorted(found) == want.tolist()
