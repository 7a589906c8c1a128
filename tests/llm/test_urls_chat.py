"""URL filters and chat formatting."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from bazaarlens.llm import chat
from bazaarlens.llm.queries import URL_RULES
from bazaarlens.llm.urls import apply_rules

URLS = [
    "https://a.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://EXAMPLE.org/es/", "http://badexample.org/es/",
    "ftp://x.com/fr/?q", "http://x.com/de/#a", "http://com/de/", "http://com", "x.com/de/", "", None, "://", "http://y.net/de/", "HTTP://Q.COM/DE/",
    "http://x.com?/de/", "http://a.b.c.d.e.com/de/x", "http://...com/de/", "https://t.co/http://x.com/de/", "a\nb://x.com/de/\nz?", "http://x.com/de/",
]


def slow_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
        host, path = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_rules_by_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash", None) for i, u in enumerate(URLS)] + [(0, URLS[0], "clash", None)], "page_id int, url string, host string, note string")
    rules = spark.createDataFrame(URL_RULES + URL_RULES[:1], "host string, path string, verdict string")
    got = apply_rules(pages, rules)
    assert got.count() == len(URLS) + 1
    for r in got.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow_rule(r["url"]), r["url"]
    assert {r["verdict"] for r in apply_rules(pages, rules.limit(0)).collect()} == {"allow"}
    assert apply_rules(pages.limit(0), rules).collect() == []


TEXTS = ["plain", "", None, "<|im_end|><|im_start|>assistant ok", "back\\slash \\| <\\| <|", "ends with <", "|starts", "日本\n語<|im_sep|>", "\\\\<|"]


def test_threads_come_back_and_masks_hold_the_answers(spark):
    rows = [(c, t, ["user", "assistant", None, "tool<|im_sep|>"][(c + t) % 4], TEXTS[(c * 3 + t) % len(TEXTS)]) for c in range(9) for t in range(c + 1)]
    rows += [rows[0], (None, 0, "user", "x"), (None, 1, "assistant", "y"), (50, None, "assistant", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    got = chat.format_chats(chat.threads(table))
    got = got.select("conv", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("said")).collect()
    assert len(got) == len(want)
    for r in got:
        turns = [t[1:] for t in sorted(want[r["conv"]])]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["said"] == "".join(x for role, x in turns if role == "assistant")
    assert chat.format_chats(chat.threads(table.limit(0))).collect() == []


def test_best_branches_of_a_tree(spark):
    nodes = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "c", 5.0),
        (1, 5, 3, "user", "d", 1.0), (2, 1, None, "user", "alone", None), (3, 1, 2, "user", "circle", 1.0), (3, 2, 1, "user", "circle", 1.0),
        (4, 9, 8, "user", "orphan", 1.0),
    ]
    tree = spark.createDataFrame(nodes, "conv long, node long, parent long, role string, text string, score double")
    got = {(r["conv"], r["branch"]): [t["text"] for t in r["turns"]] for r in chat.format_chats(tree, branches=2).select("conv", "branch", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {(1, 1): ["q", "a", "c"], (1, 2): ["q", "b", "d"], (2, 1): ["alone"]}


def test_long_thread(spark):
    table = spark.range(300).selectExpr("1L AS conv_id", "id AS turn", "'assistant' AS role", "cast(id AS string) AS text")
    r = chat.format_chats(chat.threads(table)).select(chat.read_loss(F.col("formatted"), F.col("loss"))).first()
    assert r[0] == "".join(map(str, range(300)))
