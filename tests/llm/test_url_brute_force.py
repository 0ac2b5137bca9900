"""The template tree grown page by page in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from vulnspark.llm.url_filter import Settings, judge_urls

RULES = [("bad.org/", "block"), ("shop.org/ok/", "allow"), ("shop.org/spam/", "block")]


def shape(segments):
    digits = re.sub("[0-9]+", "0", "/".join(segments))
    return len(segments), re.sub(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F0]+", "a", digits)


def label(host, path):
    best = None
    for rule, says in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            if best is None or (len(rule), rule) > best[0]:
                best = (len(rule), rule), rule, says
    return best[1:] if best else (None, None)


def grow(pages, s):
    """template per (host, path); ``pages`` counts them."""
    rows = {}
    for (host, path), n in pages.items():
        segs = path[1:].split("/", s.depth) if path else []
        rows[host, path] = {"n": n, "segs": segs, "t": "", "says": label(host, path)[1] or "none"}
    for level in range(s.depth + 1):
        groups = defaultdict(list)
        for (host, _), r in rows.items():
            if level < len(r["segs"]):
                groups[host, r["t"]].append(r)
        for members in groups.values():
            every, own = sum(r["n"] for r in members), Counter()
            for r in members:
                own[r["segs"][level]] += r["n"]
            kept = {x: n for x, n in own.items() if n >= s.support and n >= s.share * every}
            onward = defaultdict(Counter)
            for r in members:
                onward[r["segs"][level]][shape(r["segs"][level + 1 :]), r["says"]] += r["n"]
            common = sum((onward[x] for x in kept), Counter())
            total, named = sum(kept.values()), {}
            for x, n in kept.items():
                gap = sum(max(c / n - common[k] / total, 0.0) for k, c in onward[x].items())
                named[x] = "*" if gap <= s.likeness and len(kept) > 1 else x
            for r in members:
                r["t"] += "/" + named.get(r["segs"][level], "*")
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_python(spark, seed):
    rng, s = random.Random(seed), Settings()
    hosts = ["a.org", "shop.org", "x.bad.org", "big.net"]
    urls = []
    for _ in range(1500):
        host = rng.choice(hosts + ["big.net"] * 4)
        first = rng.choice(["ok", "spam", "list", "item", f"id{rng.randint(0, 99)}", "Über"])
        tail = [rng.choice(["a", "b1", f"{rng.randint(0, 500)}", f"x{rng.randint(0, 30)}-y"]) for _ in range(rng.randint(0, 5))]
        urls.append(f"http://{host}/" + "/".join([first, *tail]) if rng.random() > 0.03 else f"http://{host}")
    pages = Counter()
    for u in urls:
        host, slash, path = u[7:].partition("/")
        pages[host, slash + path] += 1
    rows = grow(pages, s)
    sums = defaultdict(Counter)
    for (host, _), r in rows.items():
        sums[host, r["t"]].update({r["says"]: r["n"], "n": r["n"]})
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    found = judge_urls(df, RULES).collect()
    assert len(found) == len(urls)
    for f in found:
        r = rows[f["host"], f["path"]]
        c = sums[f["host"], r["t"]]
        purity = (c["block"] + s.prior * s.strength) / (c["block"] + c["allow"] + s.strength)
        covered = (c["block"] + c["allow"]) / c["n"]
        assert f["template"] == r["t"] and f["purity"] == pytest.approx(purity)
        rule, says = label(f["host"], f["path"])
        learned = "block" if purity >= s.purity and covered >= s.coverage else "allow"
        assert (f["rule"], f["verdict"]) == (rule, says or learned)
