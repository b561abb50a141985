import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, topk, urls


def test_chat_round_trip(spark):
    controls = chat.Template().controls()
    rng = random.Random(3)
    texts = ["", None, "\\", "<\\/s>", "\n<</SYS>>\n", "ends <", "ends [/INST", *controls, "".join(controls), "\\\\" + controls[0], "long " * 30_000]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "[ROLE]", "a\nb"]) if c % 3 == 0 else ["system", "user", "assistant", "user", "assistant", "user"][t]
            rows.append((c, t, role, rng.choice(texts), "x", 1))
    rows += [(None, 0, "user", "no id", "x", 1), (5, 0, rows[0][2], "tie", "x", 1), (5, None, "user", "null turn", "x", 1), (6, 0, "user", "twice", "x", 1), (6, 0, "user", "twice", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, loss int")
    segments = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    by = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in sorted(rows, key=key):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        roles = [r for r, _ in turns]
        fine = roles[-1] == "assistant" and all(b in chat.Template().order.get(a, ()) for a, b in zip(["", *roles], roles, strict=False))
        assert got[c].valid == fine
    whole = segments.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()
    assert {r.conv_id: r.n for r in whole} == {c: r.formatted_chars for c, r in got.items()}
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


@pytest.mark.parametrize("kind", ["random", "ties", "huge", "ragged"])
def test_topk_equals_brute_force(spark, kind):
    rng = random.Random(9)
    rows = []
    for i in range(700):
        v = [rng.gauss(0, 1) * (2e5 if kind == "huge" else 1) for _ in range(rng.randint(1, 5) if kind == "ragged" else 6)]
        rows.append((i, [1.0, 0.5, -0.25, 0.0, 0.0, 2.0] if kind == "ties" and i % 3 else v, "x"))
    rows += [(900, None, "x"), (1000, [1.0, None], "x"), (1100, [float("nan")] * 6, "x"), (1200, [math.inf] * 6, "x"), (None, [1.0] * 6, "x"), (3, rows[3][1], "x"), (100, rows[100][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=64, pack_rows=4, k=10)
    quant = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, qv in {i: v for i, v in quant if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in quant if i != q)[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nra_stops_before_the_end():
    import numpy as np

    rows = np.zeros((4000, 3), dtype=np.int64)
    rows[:40] = 1000 - np.arange(40)[:, None]
    q, r, s, read = topk.nra(np.array([[1, 1, 1]]), np.array([-1]), rows, np.arange(4000), 5, steps=(0.05, 1.0))
    assert list(r) == [0, 1, 2, 3, 4] and list(s) == [3000, 2997, 2994, 2991, 2988] and list(read) == [0.05]


def test_nra_with_few_and_many_stopping_queries():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 12, 600):
        rows = (rng.standard_exponential((n, 4)) ** 4 * 100).astype(np.int64)
        queries = rng.integers(-3, 9, (90, 4))
        ids = np.arange(n)
        at, to, scores, read = topk.nra(queries, np.arange(90), rows, ids, 10)
        for q in range(90):
            best = sorted((-int(rows[i] @ queries[q]), i) for i in range(n) if i != q)[:10]
            got = sorted((-int(x), int(i)) for a, i, x in zip(at, to, scores, strict=True) if a == q)
            assert got[:10] == best or [g[0] for g in got[:10]] == [b[0] for b in best]
            assert set(best) <= set(got)
        if n == 600:
            assert (read < 1).mean() > 0.5


RULES = [urls.Rule("block", "com", "/en/"), urls.Rule("allow", "example.com", "/en/7"), urls.Rule("block", "org", "/es/")]


def test_url_rules_and_models(spark):
    given = [
        "http://a.example.com/en/7?x", "HTTP://A.Example.COM/en/8#y", "x://notcom/en/1", "http://com/en/", "http://b.org/es/1?/en/", "no scheme", "", None,
        "://h", "a://b://c/d", "http://h?q/p", "http://casino-x.net/fr/1", "http://É.com/en/1", "http://h\n.com/en/",
    ]
    many = [f"http://www.garden{i % 7}.net/fr/{i}" for i in range(200)] + [f"http://casino-win{i % 5}.bets.net/fr/{i}" for i in range(60)]
    fresh = ["http://xcasino-win7.betsnet.net/fr/3", "http://www.gardens.net/fr/9"]
    rows = [(i, u, "x") for i, u in enumerate([*given, *many, *fresh])]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u, _ in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule and rule.name)
        if rule:
            assert by[i].verdict == rule.verdict
    assert by[5].verdict == by[7].verdict == "allow" and by[5].score is None
    assert [by[len(rows) - 2].verdict, by[len(rows) - 1].verdict] == ["block", "allow"]
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def brute_scores(rows):
    """ln P(accepted) - ln P(rejected) per character of each (host, path, rejected), by all models and by those without its fold."""
    import re
    import zlib

    split = [(zlib.crc32(h.encode()) % urls.FOLDS, re.findall(r"[^/.\-_?&=]{0,63}[/.\-_?&=]|[^/.\-_?&=]{1,64}", h + p), bad) for h, p, bad in rows]

    def model(skip, bad):
        n, t = {}, {}
        for f, pieces, b in split:
            if f != skip and b == bad:
                for piece in pieces:
                    m = "\x02" + piece
                    for i in range(1, len(m)):
                        for o in range(min(urls.ORDER, i) + 1):
                            g = m[i - o : i + 1]
                            n[g] = n.get(g, 0) + 1
                            t[g[:-1]] = t.get(g[:-1], 0) + 1
        return n, t

    def score(pieces, models):
        total = chars = 0
        for piece in pieces:
            m = "\x02" + piece
            for i in range(1, len(m)):
                chars += 1
                for sign, (n, t) in zip((1, -1), models, strict=True):
                    p = urls.FLOOR
                    for o in range(min(urls.ORDER, i) + 1):
                        g = m[i - o : i + 1]
                        p = (n.get(g, 0) + urls.BACKOFF * p) / (t.get(g[:-1], 0) + urls.BACKOFF)
                    total += sign * math.log(p)
        return total / chars if chars else None

    by = {skip: (model(skip, False), model(skip, True)) for skip in [*range(urls.FOLDS), None]}
    return [(score(pieces, by[None]), score(pieces, by[f])) for f, pieces, _ in split]


def test_url_scores_equal_brute_force(spark):
    rng = random.Random(12)
    made = [f"http://{rng.choice(['www', 'm', 'b-log'])}.{rng.choice(['gar', 'spam', 'den', 'bets', 'é', 'pills'])}.{rng.choice(['net', 'org'])}/{rng.choice(['a', 'b_c', ''])}/{rng.randint(0, 30)}?q" for _ in range(150)]
    given = [*made, made[0], "http://" + "ab." * 30_000 + "com/" + "x" * 200_000, None, "", "none", "http://x", "http:///only/path"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")
    tie = [urls.Rule("allow", "x", "/a/"), urls.Rule("block", "x/", "a/"), urls.Rule("allow", "gar.net", "/a"), urls.Rule("block", "den.net", "/a")]
    got = {r.page_id: r for r in urls.judge_urls(df, tie).collect()}
    kind = __import__("re").compile(urls.REJECTED_HOSTS)
    order = sorted(got)
    rows = [(got[i].host, got[i].path, bool(kind.search(got[i].host))) for i in order]
    assert len(order) == len(given) and 10 < sum(b for *_, b in rows) < 140
    for i, (h, p, bad), (full, apart) in zip(order, rows, brute_scores(rows), strict=True):
        if not h + p:
            assert got[i].score is got[i].held_out_score is None and got[i].verdict == "allow"
        else:
            assert got[i].held_out_score == pytest.approx(apart, abs=1e-7)
            assert got[i].score == pytest.approx(full if bad else apart, abs=1e-7)
    assert got[0].score == got[150].score
    free = [r for r in got.values() if r.rule is None and r.score is not None]
    assert max([r.score for r in free if r.verdict == "block"], default=-99) < min(r.score for r in free if r.verdict == "allow")
    # examples of one's own: nothing in the hosts' words tells which are rejected
    examples = spark.createDataFrame([(f"http://h{i}.{'qq' if i % 2 else 'zz'}.net/1", bool(i % 2)) for i in range(40)], "url string, rejected boolean")
    fresh = spark.createDataFrame([(1, "http://new.qq.net/1"), (2, "http://new.zz.net/1")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(fresh, [], examples=examples).collect()} == {1: "block", 2: "allow"}
