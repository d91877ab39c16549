from tarnwork.llm.pii import _settle, find_personal, redact, redact_personal
from tarnwork.llm.pii_candidates import NameParts, features, label, spans

PEOPLE = ["Tavina Ostrisk", "Brimoth Vellwick", "Oskund Zarrandel", "Mirraya Lindovan", "Quelric Tunderisk", "Zephelle Corvardt"]
HINTS = [(w, k) for p in PEOPLE for w, k in zip(p.split(), ("given", "family"))]


def texts():
    out = []
    for i in range(90):
        who = PEOPLE[i % len(PEOPLE)]
        out.append((i, f"# %% [markdown]\nThe plain Tavina dataset has no header.\nsigned, {who}\nTel: +1 555 555 {i:04d}\nSSN 9{i:02d}-55-{1000 + i}\nLives at {i + 1} Rosmarin Lane.\ncontact <a{i}.b@mail.invalid>\nStreet View tiles, lane 4 of 12\nlot 20230419-0931 of 44-B\nrows 1200-1300, 1400-1555\nCell In[{i}], line 5 in Next Step of Main Loop\nid 4400112233 and 0.5550 0.0199 0.7946\n"))
    return out


def test_generators_propose_every_form():
    cases = {
        "email": ["a_b+nb@mail.invalid", "x [at] mail [dot] invalid", "y(at)post.dunvary.test", "z AT lab DOT quenmoor DOT example"],
        "phone": ["+1 555 555 0187", "+15555550185", "(555) 555-0190", "555-0194", "1.555.555.0104", "0044(0)20-7946-0454", "030/23125-741", "01 99 00 36 52"],
        "identity": ["999 504 7034", "938-17-6373", "0020.016.072-78", "XQ4808623", "99738095-T", "309987/4579"],
        "address": ["14 Ondrina St, Apt 24", "180 Tavelle Rd.", "Flat 3, 10 Sept-Fours Avenue", "142, rue Rosmarin", "177 bis, avenue Oskar-Vell", "Calle Fennimore 12, 5º B", "Rua Larkmoor, 130", "Old Kilnstraße 65", "68 TAVELLE STREET"],
        "name": ["Tavina Ostrisk", "Tavina B. Ostrisk", "T. Ostrisk", "Ostrisk, Tavina", "Tavina Ostrisk-O'Drawick", "TAVINA O'DRAWICK"],
    }
    for kind, pieces in cases.items():
        for piece in pieces:
            text = f'    "by;{piece};on\\n",'
            assert (text.index(piece), text.index(piece) + len(piece), kind) in spans(text), piece
    assert spans("") == [] and spans("a @cached b.T 1.5") == []


def test_labels_and_settling():
    text = "x\nTel: 555-0194 and\nrows 999 504 7034\n"
    s = text.index("555")
    assert label(text, s, "phone") == 1 and label(text, s, "identity") == 0 and label(text, text.index("999"), "phone") == 0
    for before, kind in (("Passport no. ", "identity"), ("health-nr.: ", "identity"), ("E-Mail: <", "email"), ("owner=", "name"), ("| Fax | ", "phone"), ("ship to: ", "address")):
        assert label(before + "x", len(before), kind) == 1, before
    assert label("hotel: x", 7, "phone") == 0 and label("x", 0, "name") == 0
    names = NameParts(HINTS)
    assert len(features(text, s, s + 8, "phone", names)) == len(features("Éa Bé", 0, 5, "name", names))
    spans_ = [{"start": a, "stop": b, "kind": "k", "piece": "", "p": p} for a, b, p in ((0, 5, 0.9), (3, 12, 0.6), (12, 14, 0.7), (12, 14, 0.8), (5, 6, 0.9))]
    assert [(r["start"], r["stop"]) for r in _settle(spans_)] == [(3, 12), (12, 14)]


def test_find_and_redact(spark):
    rows = [*texts(), (3, texts()[3][1]), (200, None), (201, ""), (202, "é " * 60_000 + "\nsigned, Tavina Zarrandel\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as start", "'x' as kind")
    hints = spark.createDataFrame([*HINTS, (None, "given")], "name_part string, part_kind string")
    found = find_personal(docs, "doc_id", "text", hints)
    got = {(r.doc_id, f.kind, f.piece) for r in found.collect() for f in r.found}
    for i, text in texts():
        want = {(i, "name", PEOPLE[i % 6]), (i, "phone", f"+1 555 555 {i:04d}"), (i, "identity", f"9{i:02d}-55-{1000 + i}"), (i, "address", f"{i + 1} Rosmarin Lane"), (i, "email", f"a{i}.b@mail.invalid")}
        assert {g for g in got if g[0] == i} == want
    assert (202, "name", "Tavina Zarrandel") in got
    after = {r.doc_id: r.text for r in redact(docs, "doc_id", "text", found).collect()}
    assert after == {r.doc_id: r.text for r in redact_personal(docs, "doc_id", "text", hints).collect()}
    assert len(after) == 93 and after[200] is None and after[201] == "" and after[202].endswith("signed, [NAME]\n") and len(after[202]) > 120_000
    assert after[5] == texts()[5][1].replace(PEOPLE[5], "[NAME]").replace("+1 555 555 0005", "[PHONE]").replace("905-55-1005", "[IDENTITY]").replace("6 Rosmarin Lane", "[ADDRESS]").replace("a5.b@mail.invalid", "[EMAIL]")
    assert find_personal(docs.limit(0), "doc_id", "text", hints).count() == 0


def test_addresses_and_local_parts_need_no_other_sign():
    assert (0, 20, "address") in spans("12 Rosmarin Larkmoor")
    assert (3, 29, "address") in spans("at Flat 3, 10 Tavelle Hill St.")[:1] or any(k == "address" and s == 3 for s, _, k in spans("at Flat 3, 10 Tavelle Hill St."))
    for n in (100, 5000):
        long = "a" * n + "@mail.invalid"
        assert (3, 3 + len(long), "email") in spans(f"to {long} now")
    for form in ("x ( at ) mail (dot) invalid", "x [ at ] mail.invalid"):
        assert any(k == "email" and s == 0 for s, _, k in spans(form)), form
    names = NameParts([("Maximilianabert", "given"), ("Maximilianalia", "given")])
    assert names.like("Maximilianaxx")[0] == 11


def test_without_labels_only_plain_forms_are_found(spark):
    texts_ = ["We flew from the Grand Canyon in North America to Mount Everest, rows 1200-1300-1400", "Linear Regression beats Monte Carlo; write to a.b@mail.invalid or +1 555 555 0187", "Tavina Ostrisk of 14 Ondrina Street"]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id int, text string")
    hints = spark.createDataFrame(HINTS, "name_part string, part_kind string")
    got = {(r.doc_id, f.kind, f.piece) for r in find_personal(docs, "doc_id", "text", hints).collect() for f in r.found}
    assert got == {(1, "email", "a.b@mail.invalid"), (1, "phone", "+1 555 555 0187"), (2, "name", "Tavina Ostrisk"), (2, "address", "14 Ondrina Street")}


def test_labels_count_wherever_they_are(spark):
    odd = [r.id for r in spark.range(20_100).where("pmod(xxhash64(id), 2) <> 0").limit(90).collect()]  # a half of the documents has no label
    rows = [(i, text) for i, (_, text) in zip(odd, texts())]
    docs = spark.range(20_100).join(spark.createDataFrame(rows, "id bigint, text string"), "id", "left").selectExpr("id as doc_id", "coalesce(text, 'rows of a table') as text")
    got = {(r.doc_id, f.kind) for r in find_personal(docs, "doc_id", "text", spark.createDataFrame(HINTS, "name_part string, part_kind string")).collect() for f in r.found}
    assert got == {(i, kind) for i in odd for kind in ("name", "phone", "identity", "address", "email")}
