import random

import numpy as np
import pyarrow as pa

from millrace.llm.bait import bait_pages
from millrace.llm.page_features import FEATURES, SIGNALS, measure, measured

RNG = random.Random(3)
THINGS, EXTRA = ["garden hose", "lamp", "plumber", "web design"], ["cheap", "best", "buy", "near me", "online", "2024", "sale", "review", "discount"]


def host():
    return "".join(RNG.choice(["ka", "lo", "mi", "ru", "ten", "vo"]) for _ in range(4)) + RNG.choice([".example", ".test", ".com"])


def phrase():
    return f"{RNG.choice(EXTRA)} {RNG.choice(THINGS[:2])} {RNG.choice(EXTRA)}"


def bait(kind):
    if kind == 0:
        return ", ".join(phrase() for _ in range(60))
    if kind == 1:
        return "\n".join(f"* https://{host()}/x/{i}" for i in range(30))
    if kind == 2:
        return "\n".join(f"[{phrase()}](http://{host()}/)" for _ in range(30))
    if kind == 3:
        return "\n".join(f'<product sku="a{i}">{phrase()}</product>' for i in range(40))
    if kind == 4:
        return "#!/bin/sh\nset -eu\n\n" + "\n".join("# " + ", ".join(phrase() for _ in range(6)) for _ in range(12))
    if kind == 5:
        words = ["षधअछ", "אזמאמ", "йпбъ", "哷媤啞"]
        return " ".join(RNG.choice(words) for _ in range(120))
    if kind == 6:
        return " ".join(f"Need a lamp in {host()[:5].title()}? Best lamp {host()[:5].title()}!" for _ in range(25))
    return " ".join(f"#{RNG.choice(EXTRA).replace(' ', '')}{RNG.choice(THINGS).replace(' ', '')}" for _ in range(60))


def fair(kind):
    if kind == 0:
        return "def f(x):\n    return x + 1\n\n" * 20
    if kind == 1:
        return "\n".join(f"lib-{host()[:6]}=={i}.{i}  # from https://{host()}/p" for i in range(30))
    if kind == 2:
        return "<urlset>\n" + "\n".join(f"<url><loc>https://one.example/{i}</loc><lastmod>2020-01-01</lastmod></url>" for i in range(30))
    if kind == 3:
        return "\n".join(f"0.0.0.0 {host()}" for _ in range(40))
    if kind == 4:
        return "\n".join(f"- [Part{i}](https://{host()}/): this page explains how the {host()[:4]} of a queue is written to the log" for i in range(15))
    if kind == 5:
        return "\n".join(sorted({host()[:8] for _ in range(80)}))
    if kind == 6:
        return "\n".join(f"test_{host()[:4]}_queue ... ok" for _ in range(40))
    return "The cache is kept until the record has been written, which is why a reader may see it twice. Every part of the log is read in order. " * 6


PROSE = {
    "de": "Die Übertragung wird fortgesetzt, sobald der Empfänger bereit ist. Jede Nachricht erhält eine laufende Nummer, mit der verlorene Teile erkannt werden. "
    "Wenn ein Knoten ausfällt, übernimmt sein Nachbar die Arbeit, ohne dass Daten verloren gehen. Ein Eintrag bleibt bestehen, bis alle Leser ihn bestätigt haben. ",
    "fr": "La file reste ouverte tant que le dernier message n'a pas été lu. Chaque enregistrement porte un numéro, ce qui permet de retrouver les parties perdues. "
    "Quand un serveur s'arrête, son voisin reprend le travail sans perdre de données. Le protocole fixe la durée pendant laquelle on attend une réponse. ",
    "es": "El registro permanece abierto hasta que todos los lectores lo hayan confirmado. Cada mensaje lleva un número con el que se detectan las partes perdidas. "
    "Si un nodo falla, su vecino continúa con el trabajo y no se pierde ningún dato. Después el servicio limpia la memoria y avisa a los demás. ",
}
STUFFED = {
    "function words": "the best lamp for the home " * 60,
    "semicolons": "; ".join(phrase() for _ in range(80)),
    "endings of any country": "\n".join(f"http://{''.join(RNG.choice(['ka', 'lo', 'mi', 'ru']) for _ in range(4))}{i}.gr/" for i in range(40)),
    "unspaced": "".join(RNG.choice(["最安値", "激安", "財布", "通販", "時計"]) for _ in range(400)),
}


def _values(text):
    got = measure(pa.array([text], pa.large_string()))
    return {c: float(v[0]) for c, v in got.items()}


def test_signals_and_features_share_nothing():
    assert not set(FEATURES) & set(SIGNALS) and set(_values("a b")) == {*FEATURES, *SIGNALS}


def test_lines_are_told_by_their_kind():
    v = _values("\n".join(f"https://{host()}/x" for _ in range(20)))
    assert v["links"] == 1 and v["hosts"] > 10 and v["words"] == 0
    v = _values("\n".join(f"{host()[:4]}.gr" for _ in range(9)))
    assert v["links"] == 1 and v["bare"] == 1
    assert _values("\n".join(["main.py", "setup.cfg", "notes.txt"] * 4))["links"] == 0
    for text in PROSE.values():
        v = _values(text)
        assert v["sentences"] > 0.95 and v["phrases"] == 0 and 5 < v["sentence_words"] < 25
    v = _values("x = f(a[0]);\n" * 8)
    assert v["code"] == 1 and v["uniform"] == 1 and v["lead"] == 1
    v = _values("red lamp buy, lamp buy red, buy red lamp, lamp red buy")
    assert v["phrases"] == v["repeated"] == 1 and abs(v["permuted"] - 7 / 3) < 1e-9 and v["variety"] == 0.25
    v = _values("#redlamp #buy_lamp #lampbuy")
    assert v["tagged"] == 1
    assert _values("r e d l a m p\u200b \u00adb u y")["short"] == 1
    assert all(x == 0 for c, x in _values("").items() if c not in ("s_packed", "s_novelty"))


def test_measures_dont_depend_on_the_slice(monkeypatch):
    texts = [bait(i % 8) for i in range(16)] + [None, "", "\n\r\n", "<a", 'b">c', "http://", "x" * 5000 + ".", "\x00\u2028 q."] + [fair(i) for i in range(8)]
    one = {c: np.concatenate([g[c] for _, _, g in measured(pa.array(texts))]) for c in FEATURES + SIGNALS}
    monkeypatch.setattr("millrace.llm.page_features.SLICE", 1)
    each = {c: np.concatenate([g[c] for _, _, g in measured(pa.array(texts))]) for c in FEATURES + SIGNALS}
    for c in one:
        assert np.allclose(one[c].astype(float), each[c].astype(float)), c


def test_a_very_long_text_is_measured_in_windows(monkeypatch):
    monkeypatch.setattr("millrace.llm.page_features.WINDOW", 5000)
    text = "\n".join(phrase() for _ in range(2000))
    (_, _, got), = measured(pa.array([text]))
    assert len(text) > 20_000 and got["phrases"][0] > 0.99 and got["variety"][0] < 0.1


def test_held_out_pages_are_told_apart(spark):
    rows = [(i, bait(i % 8), f"r{i % 9}") for i in range(160)] + [(1000 + i, fair(i % 8), f"r{i % 40}") for i in range(400)]
    rows += [(5000, None, "r1"), (5001, "", None), (5002, " \n ", "r2"), (None, bait(0), None), (3, bait(0), "r3"), (6000, (bait(1) + "\n") * 60, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, repo string").repartition(3).selectExpr("*", "1 AS k", "2 AS h", "3 AS p", "4 AS size", "5 AS label")
    got = [r["doc_id"] for r in bait_pages(df, key="doc_id", text="text", host="repo", fit_rows=300).collect()]
    found = {g for g in got if g is not None and g < 1000}
    assert len(found) >= 156 and got.count(None) == 1 and 6000 in got and got.count(3) == 2
    assert not any(g is not None and 1000 <= g < 6000 for g in got)


def test_no_cases_of_one_kind_and_no_rows(spark):
    shape = "doc_id long, text string, repo string"
    one = spark.createDataFrame([(1, bait(0), "r"), (2, bait(1), "r")], shape)
    assert sorted(r["doc_id"] for r in bait_pages(one, key="doc_id", text="text", host="repo").collect()) == [1, 2]
    assert bait_pages(spark.createDataFrame([], shape), key="doc_id", text="text", host="repo").count() == 0


def test_prose_of_other_languages_and_other_stuffing(spark):
    rows = [(i, bait(i % 8), f"r{i % 9}") for i in range(160)] + [(1000 + i, fair(i % 8), f"r{i % 40}") for i in range(400)]
    rows += [(2000 + i, p * n, "r1") for i, p in enumerate(PROSE.values()) for n in (1, 3)] + [(3000 + i, t, "r2") for i, t in enumerate(STUFFED.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string, repo string")
    found = {r["doc_id"] for r in bait_pages(df, key="doc_id", text="text", host="repo").collect()}
    assert not any(1000 <= f < 3000 for f in found)
    assert {3000 + i for i in range(len(STUFFED))} <= found


def test_one_case_among_many_is_found(spark):
    rows = [(0, bait(0), "r")] + [(1 + i, fair(i % 8), f"r{i % 40}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, repo string")
    assert [r["doc_id"] for r in bait_pages(df, key="doc_id", text="text", host="repo").collect()] == [0]


def test_hosts_count_only_where_they_differ(spark):
    from millrace.llm.bait import _between

    def of(rows):
        return _between(spark.createDataFrame(rows, "h string, __s double, __n long"))

    rate, differ, strength = of([("a", 50.0, 50), ("b", 0.0, 50), ("c", 0.0, 50)])
    assert differ and abs(rate - 1 / 3) < 1e-9 and strength == 1.0
    assert of([("a", 10.0, 50), ("b", 10.0, 50), ("c", 10.0, 50)])[1] is False
    assert of([("a", 1.0, 1)])[1] is False and of([])[1] is False
