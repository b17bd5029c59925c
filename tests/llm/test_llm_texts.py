"""Pages, scans, pairs, pieces, ids, leaks and details on small cases."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import boilerplate, encoding, leakage, pairs, privacy, scans, splitting

PROSE = "Der Bedarf an Eisen und Zink steigt, sobald Schwangere mehr als {0} Minuten trainieren, je nach Jahreszeit und Angebot."


def own(chosen):
    words = [f"wort{chr(97 + chosen.randrange(26))}{chr(97 + chosen.randrange(26))}" for _ in range(14)]
    return "Der Bedarf an " + " ".join(words) + "."


def pages():
    chosen = random.Random(1)
    rows = []
    for host in ("kornhaus", "salzfass", "ofenbank", "brotkorb"):
        for n in range(30):
            nav = ["Start", "Rezepte", "Suche"] if chosen.random() < 0.8 else ["Start > Rezepte > Suche"]
            crumb = [f"Start » Rezepte » Thema {host}{n} gut gekocht"]
            body = [own(chosen)[14:-1].title(), own(chosen), f"- {n + 3} g Linsen", "", own(chosen)]
            related = ["Mehr zum Thema", own(chosen)[14:40].title(), own(chosen)[14:40].title()] if n % 3 else []
            foot = [f"© 20{n % 20:02d} {host.title()}", "Impressum"]
            lines = nav + crumb + body + related + foot
            flags = [True] * (len(nav) + 1) + [False] * 5 + [True] * (len(related) + 2)
            rows.append((len(rows), f"{host}_{len(rows)}.html", "\n".join(lines), [i for i, (x, f) in enumerate(zip(lines, flags), 1) if f and x]))
    return rows


@pytest.mark.parametrize("bound", [300_000, 0])
def test_furniture(spark, monkeypatch, bound):
    """The same lines whether the winning paths are sent around or joined."""
    monkeypatch.setattr(boilerplate, "BROADCAST_PATHS", bound)
    monkeypatch.setattr(boilerplate, "GROUP_PAGES", 12)
    rows = pages()
    meta = "struct<folder:string,doc_type:string,source:string>"
    chunks = [(i, i, t, ("f", "HTML", s if i % 10 else None)) for i, s, t, _ in rows] + [(900, 900, None, ("f", "HTML", "kornhaus_900.html")), (901, 901, "", ("f", "HTML", None)), (902, 902, "Start", ("f", "PDF", None)), (903, 903, PROSE.format(1), (None, "HTML", None))]
    df = spark.createDataFrame(chunks + chunks[:5], f"chunk_id bigint, doc_id bigint, text string, metadata {meta}")
    files = spark.createDataFrame([(i, f"root/HTML/x/{s}") for i, s, *_ in rows], "doc_id bigint, path string")
    found = boilerplate.pages_of(df, files)
    got = {(r["chunk_id"], r["line_no"]) for r in boilerplate.furniture_lines(found).collect()}
    expected = {(i, n) for i, *_, cut in rows for n in cut}
    assert len(got & expected) >= 0.98 * len(expected) and len(got - expected) <= 0.02 * len(expected)
    body = {r["chunk_id"]: r["body"] for r in boilerplate.main_bodies(found).collect()}
    assert "Impressum" not in body[1] and "g Linsen" in body[1] and body[903] == PROSE.format(1)


def test_long_rows():
    """A row of many links is a row however long; one made of winning paths without separators is furniture too."""
    names = [f"Thema{chr(97 + i)} und mehr" for i in range(20)]
    assert boilerplate.kind_of(" · ".join(names)) == "r" and boilerplate.kind_of(PROSE.format(2) + " / " + PROSE.format(3)) == "s"
    reader, won = boilerplate.Reader(), {boilerplate.path_key(x) for x in names}
    joined = "\n".join([" ".join(names[:6]), " · ".join(names), "Eisen und mehr"])
    assert reader.furniture(joined, won.__contains__, lambda key: False) == [1, 2]


def test_container_scores():
    """Links score nothing, running text and the title above it nearly all, items nothing they are not."""
    reader = boilerplate.Reader()
    page = f"Start | Suche | Hilfe\nMenü öffnen\nEisen im Alltag\n{PROSE.format(3)}\n\n{PROSE.format(4)}\n- 3 g Linsen\nMeistgelesen\nTofu oder Linsen: was ist besser?"
    scores = reader.scores(reader.lines(page))
    assert scores[0] == scores[1] == scores[-1] == scores[-2] == 0 and scores[2] == scores[3] == scores[5] > 0.9 and scores[4] == 0
    assert reader.scores([]) == [] and reader.scores(reader.lines("\n\n")) == [0, 0, 0]


SCAN = """Merkheft Kost Bd. 4   17
1.2 Eisen im Alltag
Der Bedarf an Eisen und Zink steigt, sobald Schwangere
mehr als zwanzig Minuten trainieren, je nach Jahres-
zeit und Angebot. Typ-2-
Diabetes bleibt davon unberührt, ebenso Obst- und
Gemüsesorten. Die Praxis rät zu kleinen Mahl¬
zeiten, die rnan am Abend isst.
– 17 –
Merkheft Kost Bd. 4   18
Der Vi†amin-Status sollte geprüft werden, so lautet
der Rat der Fachleute."""


def test_scan_lines():
    assert scans.is_scan(SCAN) and not scans.is_scan(PROSE * 3) and not scans.is_scan(None) and not scans.is_scan("| a |\n| b |\n| c |")
    known = {"rnan": "man", "vi†amin-status": "vitamin-status"}
    page = scans.Page(scans.LineModel().fit([]), {})
    got = scans.defects(SCAN, page.states([SCAN])[0], known.get)
    assert got == [(1, "header"), (4, "hyphen"), (7, "hyphen"), (8, "char"), (9, "page_no"), (10, "header"), (11, "char")]
    text = scans.paragraphs(SCAN, page.states([SCAN])[0], known.get)
    assert "Jahreszeit und Angebot. Typ-2-Diabetes" in text and "Mahlzeiten, die man am" in text and "Merkheft" not in text and "17" not in text


@pytest.mark.parametrize("bound", [300_000, 0])
def test_scan_defects(spark, monkeypatch, bound):
    """The same lines whether misread words and recurring lines are sent around or joined."""
    monkeypatch.setattr(scans, "BROADCAST_WORDS", bound)
    monkeypatch.setattr(scans, "BROADCAST_LINES", bound)
    meta = "struct<folder:string,doc_type:string,source:string>"
    rows = [(i, SCAN.replace("17", str(17 + i)), ("f", "PDF", None)) for i in range(12)] + [(50, None, ("f", "PDF", None)), (51, "", ("f", "PDF", None)), (52, "man " * 3000, ("f", "PDF", None)), (53, SCAN, ("f", "HTML", None)), (54, "x" * 100_000 + "\n" + "m" * 5000, None), (55, "man sieht " * 200, ("f", "PDF", None))]
    df = spark.createDataFrame(rows + rows[:3], f"chunk_id bigint, text string, metadata {meta}")
    got = scans.scan_defects(df).collect()
    assert {(r["line_no"], r["kind"]) for r in got if r["chunk_id"] == 3} >= {(1, "header"), (4, "hyphen"), (7, "hyphen"), (8, "char"), (9, "page_no"), (10, "header"), (11, "char")}
    assert {r["chunk_id"] for r in got} == set(range(12)) and len(got) == len(set(map(tuple, got)))
    assert scans.scan_defects(df.where("false")).count() == 0
    texts = {r["chunk_id"]: r["text"] for r in scans.repaired_texts(df).collect()}
    assert set(texts) == set(range(12)) and "Jahreszeit und Angebot" in texts[3]


def test_wide_line(spark):
    """One line beyond the width of the others shuts no page out."""
    wide = SCAN + "\n" + "Diese eine Zeile ist beim Einlesen nicht umgebrochen worden und läuft deshalb weit über den Satzspiegel hinaus."
    assert len(wide.split("\n")[-1]) > 97
    df = spark.createDataFrame([(i, wide, ("f", "PDF", None)) for i in range(3)], "chunk_id bigint, text string, metadata struct<folder:string,doc_type:string,source:string>")
    got = {(r["line_no"], r["kind"]) for r in scans.scan_defects(df).collect() if r["chunk_id"] == 1}
    assert got >= {(1, "header"), (4, "hyphen"), (7, "hyphen"), (9, "page_no"), (10, "header")} and not any(n == 13 for n, _ in got)


def _volume(chosen, words, titles, stock):
    """Pages of one volume with their true states: a running title that few others have, with or without a number, page
    numbers now and then, and short paragraphs, some of which start with a stock line."""
    title, width, lines, states = chosen.choice(titles), chosen.randrange(44, 70), [], []
    for page in range(chosen.randrange(2, 4)):
        if chosen.random() < 0.6:
            lines.append(chosen.choice([title, title, title, f"{page + 20}   {title}", f"{title}   {page + 20}"]))
            states.append(scans.HEADER)
        line, end = "", False
        for _ in range(chosen.randrange(30, 60)):
            if end and chosen.random() < 0.3:
                lines += [line] if chosen.random() < 0.5 else [line, chosen.choice(stock)]
                states += [scans.BODY] * (len(lines) - len(states))
                line = ""
            word = chosen.choice(words)
            word = word.capitalize() if end or not line and not states[-1:] or chosen.random() < 0.3 else word
            end = chosen.random() < 0.1
            word += "." if end else ""
            if len(line) + 1 + len(word) > width:
                lines.append(line)
                states.append(scans.BODY)
                line = word
            else:
                line = f"{line} {word}".strip()
        lines.append(line.rstrip(".") + ".")
        states.append(scans.BODY)
        if chosen.random() < 0.7:
            lines.append(str(page + 20))
            states.append(scans.PAGE_NO)
    return lines, states


def test_line_model_decides():
    """The fitted sequence decides: without the fit, or by the shape of a line alone, far more lines are wrong."""
    chosen = random.Random(11)
    words = ["".join(chosen.choice(x) for x in ("bdfgkl", "aeiou", "mnrst", "aeiou", "lnrt")[: chosen.randrange(2, 6)]) for _ in range(400)]
    titles = [" ".join(chosen.choice(words).capitalize() for _ in range(chosen.randrange(2, 6))) for _ in range(300)]
    stock = [" ".join(chosen.choice(words) for _ in range(chosen.randrange(4, 8))).capitalize() for _ in range(8)]
    made = [_volume(chosen, words, titles, stock) for _ in range(400)]
    count = Counter(k for lines, _ in made for k in {scans.header_key(x) for x in lines if scans.may_recur(x, scans.shape_of(x))})
    seen = [scans.observed(lines, {k: n for k, n in count.items() if n >= 3}.get) for lines, _ in made]

    def wrong(model):
        return sum(((a == scans.HEADER) != (b == scans.HEADER)) for got, (_, states) in zip(model.label(seen), made) for a, b in zip(got, states))

    fitted, unfitted = scans.LineModel().fit(seen), scans.LineModel().fit(seen, 0)
    total = sum(b == scans.HEADER for _, states in made for b in states)
    by_shape = sum((row[0] == scans.DETACHED) != (b == scans.HEADER) for rows, (_, states) in zip(seen, made) for row, b in zip(rows, states))
    assert wrong(fitted) <= 0.02 * total and wrong(unfitted) > 4 * wrong(fitted) and by_shape > 0.2 * total
    # some lines are headers behind a page number and text inside a page, whatever they look like
    rows = np.unique(np.concatenate(seen), axis=0)
    scores = sum(e[:, rows[:, f]] for f, e in enumerate(fitted.emit))
    number, inside = (rows[np.argmax(scores[s])] for s in (scans.PAGE_NO, scans.BODY))
    places = fitted.label([np.stack([x, row, inside]) for row in rows for x in (number, inside)])
    assert any(a[1] == scans.HEADER and b[1] == scans.BODY for a, b in zip(places[::2], places[1::2]))


def test_long_runs():
    """A run of characters without a blank gives few variants, none of them for each of its letters."""
    assert len(scans.unread("cl" * 50_000)) < 10 and "verstopfung" in scans.unread("verstopfiing") | scans.unread("verst0pfung")


Q = "Wie viel Eisen brauche ich mit 40 Jahren, wenn ich kaum Linsen esse?"
PAIRS = [
    (Q, None, "empty"), (Q, " ​\n", "empty"), (Q, "n/a", "empty"), (Q, "<p></p>", "empty"), (Q, "Antwort:", "empty"),
    (Q, "Server disconnected", "error"), (Q, '{"error": "model not loaded", "code": 502}', "error"), (Q, "Traceback (most recent call last): KeyError 'response'", "error"),
    (Q, "Dazu kann ich leider nichts sagen. Bitte wenden Sie sich an eine Fachkraft.", "refusal"), (Q, "Es tut mir leid, diese Frage kann ich nicht beantworten.", "refusal"),
    (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, f"Ihre Frage lautet: {Q}", "copy"), (Q, f"{Q} {Q}", "copy"), ("Hilft Süßes gegen Heißhunger?", "HILFT SÜSSES GEGEN HEISSHUNGER?", "copy"),
    (Q, "Lentils and beans supply about 12 g of iron per serving. A lack of iron often shows as fatigue.", "language"),
    (Q, "Mit 12 mg Eisen am Tag kommen Erwachsene meist gut aus, weil die", "truncated"), (Q, "Beachten Sie dabei folgende Punkte:", "truncated"), (Q, "Mit 12 mg kommen Sie aus.\n1. Linsen helfen dabei gut.\n2.", "truncated"),
    (Q, "Etwa 20 g.", None), (Q, "Ja, zweimal pro Woche.", None), (Q, f"Sie fragen: {Q} Mit 12 mg Eisen am Tag kommen Sie gut aus, und Linsen sind dafür nicht nötig.", None),
    (Q, "Das kann ich nicht empfehlen: Linsen verstärken die Beschwerden. Mit 12 mg Eisen am Tag kommen Sie meist gut aus.", None),
    (Q, "Geeignet sind vor allem:\n- Linsen\n- Rote Bete\n- Sesam", None), (Q, "In einer Studie heißt es: „Eating oats adds iron“. Mit 12 mg Eisen am Tag kommen Erwachsene meist gut aus, wenn sie genug trinken.", None),
    (Q, "Mit 12 mg Eisen am Tag kommen Erwachsene meist gut aus (Stand 2023)", None), (None, "Mit 12 mg Eisen am Tag kommen Sie aus.", None),
]


def test_pairs(spark):
    rows = [(i, q, a, "x") for i, (q, a, _) in enumerate(PAIRS)]
    df = spark.createDataFrame(rows + rows[:4] + [(900, Q, "Linsen helfen gut. " * 4000, "x")], "query_id bigint, query string, answer string, defect string")
    got = {r["query_id"]: r["defect"] for r in pairs.pair_defects(df).collect()}
    assert {i: got.get(i) for i in range(len(PAIRS))} == {i: d for i, (_, _, d) in enumerate(PAIRS)} and 900 not in got
    assert pairs.pair_defects(df.where("false")).count() == 0


E = "How much iron do vegans need per day?"
#: Wording and languages that no cue, seed or table holds.
UNSEEN = [
    (Q, "Mercimek ve fasulye porsiyon başına yaklaşık on iki miligram demir sağlar. Yeterince su için ve günde iki kez yiyin.", "language"),
    (Q, "Soczewica i fasola dostarczają około dwunastu miligramów żelaza na porcję. Niedobór żelaza często objawia się zmęczeniem.", "language"),
    (Q, "Linzen en bonen leveren ongeveer 12 mg ijzer per portie. Een tekort aan ijzer uit zich vaak in vermoeidheid.", "language"),
    (Q, "Lencse és bab körülbelül 12 mg vasat tartalmaz adagonként.", "language"), (E, "Linzen en bonen leveren ongeveer 12 mg ijzer per portie. Een tekort uit zich vaak in vermoeidheid.", "language"),
    (Q, "Zu medizinischen Fragen äußere ich mich grundsätzlich nicht.", "refusal"), (Q, "Ich kann Ihnen hierbei bedauerlicherweise nicht weiterhelfen. Fragen Sie Ihre Ärztin.", "refusal"),
    (E, "I don't have enough information to answer that.", "refusal"), (E, "Unfortunately I can't provide medical advice.", "refusal"), (Q, "RuntimeError: model crashed while loading weights", "error"),
    (E, "java.lang.NullPointerException at Main.run(Main.java:41)", "error"), (E, "You wanted to know: " + E, "copy"), (Q, "Erwachsene brauchen etwa 12 mg am Tag. Gute Quellen sind Lins", "truncated"),
    (E, "Adults need about 8 mg a day. Good sources are lentils and", "truncated"), (E, "Yes, lentils and tofu help.", None), (Q, "Linsen, Hafer und Sesam.", None),
    (Q, "Leider nein: Tee hemmt die Aufnahme von Eisen. Trinken Sie ihn erst zwei Stunden nach dem Essen.", None),
]


def test_unseen_wording(spark):
    """The field decides where cues fail: on unseen wording it is right more often than the cues it was trained by."""
    rows = spark.read.parquet("/root/testdata/sf0.01/rag_results.parquet").select("query", "answer").where("answer is not null").distinct().collect()
    judge = pairs.trained(sorted(map(tuple, rows), key=str))
    field = judge.defects([(q, a) for q, a, _ in UNSEEN])
    by_cues = []
    for query, answer, _ in UNSEEN:
        found = pairs.clauses(pairs.visible(answer))
        by_cues.append(pairs.defect_of([len(c) for c in found], pairs.cued(judge.reader.query(query)[0], found)))
    wrong = lambda got: sum(x != d for x, (_, _, d) in zip(got, UNSEEN))
    assert wrong(field) <= 1 and wrong(by_cues) > wrong(field) + 1


def test_all_pairs_are_trained_on(spark, monkeypatch):
    """Beyond what the driver trains on, every pair has its part in the weights, and every word in the letters; any partitioning gives the same."""
    rows = [(i, f"Hilft q{i}x bei Eisenmangel und Anämie?", f"Ja, a{i}y hilft und ist gesund. Die Dosis ist {i} mg am Tag.") for i in range(2600)]
    df = spark.createDataFrame(rows + rows[:50], "query_id bigint, query string, answer string")
    monkeypatch.setattr(pairs, "SHARD", 900, raising=False)
    judge = pairs.fitted(df.repartition(3))
    number = pairs._Numbers()
    assert all(judge.field.w[number[f"a{i}y"]].any() for i in range(2600))
    assert judge.reader.languages.tables["de"][0]["^a1"] == sum(str(i).startswith("1") for i in range(2600))
    assert judge.reader.languages.usual["de"][1] < 1 and {"gesund", "tag"} <= judge.reader.vocabulary
    assert judge.defects([(rows[0][1], rows[0][2]), (rows[0][1], rows[0][1])]) == [None, "copy"]
    again = pairs.fitted(df.repartition(7).orderBy(F.desc("query_id")))
    assert np.allclose(again.field.w, judge.field.w) and np.allclose(again.field.t, judge.field.t)


def test_cut_points():
    chosen = random.Random(4)
    for n in range(300):
        text = "".join(chosen.choice(["wort ", "a. ", "\n", "\n\n", "x", "| y |\n", ", "]) for _ in range(chosen.randrange(1, 2500)))
        room, overlap = chosen.choice([(900, 200), (300, 50), (401, 200)])
        spans = splitting.cut_points(text, room, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= room for a, b in spans)
        assert all(c == b - overlap and d > b for (_, b), (c, d) in zip(spans, spans[1:]))
    spans = splitting.cut_points("Ein Satz mit Wort. " * 200, 1000, 200)
    assert all(("Ein Satz mit Wort. " * 200)[b - 2 : b] == ". " for _, b in spans)
    assert len(splitting.cut_points("ä" * 10_000, 2400, 200)) == 5


@pytest.mark.parametrize("room", range(201, 261))
def test_tight_rooms(room):
    """Metadata that leaves little room makes many pieces, not many trials."""
    text = "wort und satz. " * 667
    started = time.perf_counter()
    spans = splitting.cut_points(text, room, 200)
    assert time.perf_counter() - started < 1
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= room for a, b in spans) and all(c == b - 200 and d > b for (_, b), (c, d) in zip(spans, spans[1:]))


def test_versions_of_an_item(spark):
    rows = [(1, "a " * 2000, None), (1, "b " * 5000, None), (1, "a " * 2000, None)]
    out = splitting.pieces_of(spark.createDataFrame(rows, "chunk_id bigint, text string, metadata struct<folder:string,doc_type:string,source:string>")).collect()
    assert len({r["text"][0] for r in out}) == 1 and len(out) == out[0]["pieces"]


def test_pieces(spark):
    meta = "struct<folder:string,doc_type:string,source:string>"
    rows = [(1, "x" * 2389, ("f", "PDF", "abcdefg")), (2, "x" * 2390, ("f", "PDF", "abcdefg")), (3, None, ("f" * 3000, None, None)), (4, "y" * 5000, None), (5, "z " * 900, ("f" * 2300, "PDF", None)), (6, "", None), (7, "\U0001f600" * 2400, None)]
    df = spark.createDataFrame(rows + rows[1:2], f"chunk_id bigint, text string, metadata {meta}")
    out = splitting.pieces_of(df).orderBy("chunk_id", "piece_no").collect()
    assert {r["chunk_id"] for r in out} == {2, 4, 5} and sum(r["chunk_id"] == 2 for r in out) == 2
    assert all(r["metadata"] == (("f", "PDF", "abcdefg") if r["chunk_id"] == 2 else r["metadata"]) for r in out)
    assert {r["over_limit"] for r in out if r["chunk_id"] == 5} == {True} and {r["over_limit"] for r in out if r["chunk_id"] == 4} == {False}
    whole = "".join(r["text"][200 if r["piece_no"] else 0 :] for r in out if r["chunk_id"] == 4)
    assert whole == "y" * 5000


@pytest.fixture(scope="module")
def encoder():
    return encoding.BytePairEncoder(f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken")


def test_ids_against_the_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    chosen = random.Random(9)
    texts = ["", " ", "  a", "a  ", "\n\n x", "don't I'LL", "<|endoftext|>", "été ä", "维生素D 每天 20 微克", "\U0001f468‍\U0001f373", "x" * 4000, "ab" * 3000 + "1" * 999, "　  a b\x1c\x85c"]
    texts += ["".join(chr(chosen.choice([chosen.randrange(32, 127), chosen.randrange(0x250), chosen.randrange(0xE000), 32, 10, 9, 39])) for _ in range(chosen.randrange(1, 30))) for _ in range(3000)]
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    wrong = sum(encoder.encode(t) != library.encode(t, add_special_tokens=False).ids for t in texts)
    assert wrong <= 1  # letters that only one side's Unicode tables know


def test_ids_round_trip(encoder):
    back = {v: k for k, v in encoder.ids.items()}
    chosen = random.Random(2)
    for n in (1, 50, 5000, 60_000):
        text = "".join(chr(chosen.choice([chosen.randrange(32, 127), chosen.randrange(0xA0, 0x500), 0x1F600])) for _ in range(n))
        assert b"".join(back[i] for i in encoder.encode(text)).decode() == text


def test_rank_queue():
    queue = encoding.RankQueue(50_000)
    chosen = random.Random(3)
    waiting = [chosen.randrange(50_000) for _ in range(2000)]
    for rank in waiting:
        queue.push(rank, rank)
    out = []
    while (got := queue.pop()) is not None:
        assert all(e == got[0] for e in got[1])
        out += got[1]
    assert out == sorted(waiting)


def test_token_ids(spark):
    df = spark.createDataFrame([(1, "Vitamin C"), (2, None), (3, ""), (3, ""), (4, "x " * 50_000)], "doc_id bigint, text string")
    rows = encoding.token_ids(df).collect()
    assert len(rows) == 5 and [r["ids"] for r in rows if r["doc_id"] in (2, 3)] == [[], [], []] and all(r["ids"] is not None for r in rows)
    assert encoding.token_ids(df.where("false")).count() == 0


ITEM = "Die Musterlösung nennt 95 Milligramm Zink, verteilt auf Feldsalat, Wasser und Rote Bete, jedoch nie nach längerer Krankheit. Großer Ärger über süße Soße bleibt dabei außer Betracht und Übung macht ohnehin den Meister."


def leaks():
    words = ITEM.split()
    return [
        (1, "Vorab: " + ITEM + " Ende.", True), (2, " ".join(words[3:13]), True), (3, " ".join(words[3:12]), False), (4, ITEM.upper().replace(" ", "\n  "), True),
        (5, "**" + " ** ".join(words) + "**", True), (6, ITEM.replace("ö", "oe").replace("ä", "ae").replace("ß", "ss"), True), (7, "­".join(ITEM), True),
        (8, ITEM.replace("ö", "ö").replace("ä", "ä"), True), (9, " ".join(w if i % 9 else "anders" for i, w in enumerate(words)), False), (10, None, False), (11, "", False), (13, "<b>" + "</b> <i class='x'>".join(words) + "</i>", True), (14, ITEM.replace("ö", "&ouml;").replace(" ", "&nbsp;"), True), (12, "wort " * 20_000 + ITEM, True),
    ]


@pytest.mark.parametrize("bound", [20_000, 0])
def test_leaks(spark, monkeypatch, bound):
    """The same cases whether the test side is sent around or joined."""
    monkeypatch.setattr(leakage, "BROADCAST_ITEMS", bound)
    docs = spark.createDataFrame([(i, t) for i, t, _ in leaks()] * 2, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM), (8, "kurz"), (9, None), (10, "ganz andere Worte " * 10)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked(docs, items).collect()}
    assert got == {(i, 7) for i, _, leaked in leaks() if leaked}
    assert leakage.leaked(docs.where("false"), items).count() == leakage.leaked(docs, items.where("false")).count() == 0


def test_common_phrases(spark, monkeypatch):
    """A phrase of nine words that all items and documents have gives no hit; one that many items have gives the real cases."""
    monkeypatch.setattr(leakage, "BROADCAST_ITEMS", 0)
    monkeypatch.setattr(leakage, "COMMON", 5)
    phrase = "diese neun worte stehen in jedem text gleich da"
    items = [(i, f"{phrase} eigen{i} nur{i} hier{i}") for i in range(20)]
    docs = [(i, f"davor{i} {phrase} danach{i} noch{i}") for i in range(30)] + [(100 + i, f"x{i} {phrase} eigen{i} y") for i in range(20)]
    got = leakage.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["words"]) for r in got) == [(100 + i, i, 10) for i in range(20)]
    hits = leakage._hits(*(leakage._fingerprints(spark.createDataFrame(rows, f"{key} bigint, text string"), key) for rows, key in ((docs, "doc_id"), (items, "item_id"))))
    assert hits.count() == 20


def test_winnowing_guarantee():
    chosen = random.Random(8)
    hasher = leakage.WordHasher()
    for _ in range(200):
        shared = [f"s{chosen.randrange(50)}" for _ in range(leakage.CASE)]
        sides = [[f"{side}{chosen.randrange(9)}" for _ in range(chosen.randrange(30))] + shared + [f"{side}{chosen.randrange(9)}" for _ in range(chosen.randrange(30))] for side in "ab"]
        owner, _, value = leakage.winnow(*hasher.flat(sides))
        assert set(value[owner == 0].tolist()) & set(value[owner == 1].tolist())


PERSON = """Patient: BÄRLBEIN, Theda, geb. am 05.15.1982, Versichertennummer L540864884, wohnhaft Unter den Weiden 117, 40647 Erlenfurt.
Kontakt: Gesine K. Brenkhain; gesine.brenkhain@nord.invalid; 030 - 23125 900
E-Mail: kirschsieck+kost [at] praxis-erlenfurt[punkt]example
Frau Fahrendonk (Tel. +49 (0)40 66969-430) übernimmt die Kochgruppe.
Steuer-ID: 28 976 019 084
Anschrift für den Versand: Holunderweg 121
22182 Nordhagen am See
Liebe Grüße, Svea

"""
CLEAR = """Charge L3800-9677, mindestens haltbar. Studie 2022-00552-22, Band 552, Seiten 5001–9740. Version 2.28.276 vom 28.04.2001.
Als Beilage gab es Caesar-Salat und danach Birne Helene. Frau und Mann brauchen 20 mg. Danke @kuechenfee20 für 5 g @ 20 °C!
Auf der Straße nach Erlenfurt stehen 131 Apfelbäume. 0123456789012345678901234567890
"""
EXPECTED = {("name", "BÄRLBEIN, Theda"), ("id_number", "L540864884"), ("address", "Unter den Weiden 117, 40647 Erlenfurt"), ("name", "Gesine K. Brenkhain"), ("email", "gesine.brenkhain@nord.invalid"), ("phone", "030 - 23125 900"), ("email", "kirschsieck+kost [at] praxis-erlenfurt[punkt]example"), ("name", "Fahrendonk"), ("phone", "+49 (0)40 66969-430"), ("id_number", "28 976 019 084"), ("address", "Holunderweg 121 22182 Nordhagen am See"), ("name", "Svea")}


def test_details(spark):
    rows = [(i, PERSON + CLEAR * (i % 3)) for i in range(20)] + [(50, CLEAR), (51, None), (52, ""), (53, "wort " * 30_000 + PERSON)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = privacy.details(df).collect()
    for doc in (0, 1, 2, 53):
        assert {(r["kind"], r["value"]) for r in got if r["doc_id"] == doc} == EXPECTED
    assert not [r for r in got if r["doc_id"] in (50, 51, 52)]
    masked = {r["doc_id"]: r["text"] for r in privacy.masked_texts(df).collect()}
    assert masked[50] == CLEAR and masked[51] is None and masked[52] == ""
    assert "Svea" not in masked[1] and "[NAME]" in masked[1] and masked[1].endswith(CLEAR) and "übernimmt die Kochgruppe." in masked[1]
    assert privacy.details(df.where("false")).count() == 0


def test_neighbouring_addresses():
    """A second address close behind another one, true or not, is proposed too."""
    for first in ("Torfstraße 107 b", "Im Mai 3"):
        text = f"Wohnhaft {first}\nAnschrift für den Versand: Kastanienallee 9\n23935 Nordhagen am See"
        assert [text[s:e] for kind, s, e, _, _ in privacy.proposed(text) if kind == "address"] == [first, "Kastanienallee 9\n23935 Nordhagen am See"]


def test_labels_in_any_case():
    """Numbers behind labels in any case, and well-formed ones without a label, are proposed."""
    for label, number in (("social security number", "123-45-6789"), ("national insurance number", "QQ 12 34 56 C"), ("id card no.", "T22000129"), ("NI No.", "AB123456C"), ("STEUERNUMMER:", "133/8150/8159"), ("SVNR. und", "65 170839 J 003"), ("", "28 976 019 084")):
        text = f"Das ist alles, was wir haben: {label} {number}, sonst nichts."
        assert number in [text[s:e] for kind, s, e, _, _ in privacy.proposed(text) if kind == "id_number"], label


def test_long_furniture(spark):
    """Lists of links of any length, bulleted or not, and long or bulleted lines that recur on a host."""
    chosen = random.Random(4)
    notice = "Wir verwenden Cookies und ähnliche Techniken, " + "um Inhalte anzuzeigen und Zugriffe auszuwerten, " * 5 + "Details stehen im Hinweis."
    rows, expected = [], set()
    for host in ("kornhaus", "salzfass", "ofenbank", "brotkorb"):
        for n in range(20):
            links = [("- " if n % 2 else "") + own(chosen)[14:40].title() for _ in range(7)]
            lines = ["- Start", "- Rezepte", own(chosen), f"- {n + 3} g Linsen", own(chosen), "Mehr zum Thema", *links, "", own(chosen), notice]
            expected |= {(len(rows), i) for i in [1, 2, *range(6, 14), 16]}
            rows.append((len(rows), "\n".join(lines), host))
    df = spark.createDataFrame(rows, "chunk_id bigint, text string, name string").selectExpr("chunk_id", "text", "xxhash64(name) AS host")
    assert {tuple(r) for r in boilerplate.furniture_lines(df).collect()} == expected
