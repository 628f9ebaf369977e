from collections import defaultdict

from hazegrid.llm import pii

TEXT = ("Mr. John Smith (john.smith@mail.example.com) and Frau Weber: +1 (017) 555-7713 or +10175557713, card 4111 1111 1111 1111, "
        "ip 192.168.1.9, not 999.1.1.1, ssn 123-45-6789, no card 4111111111111112. Госпожа Иванова, JOHN.SMITH@MAIL.EXAMPLE.COM!")


def kinds(text):
    return [h[2].split("/")[0] for h in pii.detect(text)]


def test_detected_kinds():
    assert kinds(TEXT) == ["name", "email", "name", "phone", "phone", "card", "ip", "ssn", "name", "email"]
    assert kinds("version 1.2.3 of 2024-01-02 at 12:30, 555 items, a@b, @x.com, 1234567890123456") == []
    assert kinds("") == [] and kinds("größe.34@mail7.example.com.") == ["email"]


def test_surrogates_keep_type_and_format():
    for start, end, kind, value in pii.detect(TEXT):
        new = pii.surrogate(kind, value, 0)
        shown = pii.written(kind, TEXT[start:end], new)
        assert new != value and new == pii.surrogate(kind, value, 0) != pii.surrogate(kind, value, 0, b"other key")
        again = pii.detect(("Mr. " if kind.startswith("name") else "") + shown)
        assert [h[2].split("/")[0] for h in again] == [kind.split("/")[0]]
        if not kind.startswith(("name", "ip")):
            assert [c.isdigit() for c in shown] == [c.isdigit() for c in TEXT[start:end]]
    assert pii.luhn_rest(pii.surrogate("card", "4111111111111111", 0)) == 0
    assert pii.surrogate("ip", "10.1.2.3", 0).startswith("10.") and pii.surrogate("phone", "+4930123456", 0).startswith("+49")
    assert pii.surrogate("name/f/latin", "anna weber", 0).split()[0].capitalize() in pii.GIVEN["latin", "f"]
    assert pii.script_of(pii.surrogate("name/m/cyrillic", "иван петров", 0)) == "cyrillic"


def test_shared_parts_stay_shared():
    a, b = (pii.surrogate("email", x, 0).split("@")[1] for x in ("a@corp.org", "b@corp.org"))
    assert a == b and a.endswith(".org")
    assert pii.surrogate("name/m/latin", "jo weber", 0).split()[1] == pii.surrogate("name/f/latin", "weber", 0)


def test_surrogates_stay_distinct(spark):
    """More names than the pool has: collisions are drawn anew until none is left."""
    names = [("name/m/latin", f"name{i} sur{i}") for i in range(600)] + [("name/f/latin", f"sur{i}") for i in range(100)]
    names += [("name/m/latin", "ivan urban"), ("ip", "10.0.0.1"), ("ip", "10.0.0.2")]
    out = pii.distinct_surrogates(spark.createDataFrame(names, "kind string, value string")).collect()
    drawn = [(r.kind.split("/")[0], r.drawn) for r in out]
    assert len(out) == len(names) == len(set(drawn))
    assert not set(drawn) & {(r.kind.split("/")[0], r.value) for r in out} and any(r.attempt for r in out)


def test_rows(spark, edge_docs, edge_rows, no_docs):
    rows = [(1, TEXT), (2, TEXT.replace("Mr. ", "")), (2, TEXT), (3, None), (4, ""), (None, "write to x@y.org"), (5, "nothing " * 5000 + "x@y.org")]
    rows += [(10 + i, f"Mr. Name{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]} Sur") for i in range(100)]
    d = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, kind string, digest int")
    out = pii.replace_pii(d).collect()
    assert len(out) == len(rows)
    one, three = next(r for r in out if r.doc_id == 1), next(r for r in out if r.doc_id == 3)
    assert one.n_entities == 10 and three.text is None and three.n_entities == 0
    assert "Smith" not in one.text and "smith@" not in one.text.lower() and "999.1.1.1" in one.text and "4111111111111112" in one.text
    seen = defaultdict(set)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r[1])
    for r in out:
        for t in by_id[r.doc_id]:
            if t and len(pii.detect(t)) == len(pii.detect(r.text)) and r.doc_id != 2:
                for a, b in zip(pii.detect(t), pii.detect(r.text)):
                    seen[a[3]].add(b[3])
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)
    same = {(r.doc_id, r.text) for r in pii.replace_pii(edge_docs).collect()}
    assert same == {(r[0], r[1]) for r in edge_rows}
    assert pii.replace_pii(no_docs).count() == 0


def test_names_are_taken_whole():
    """Any script, capitals, apostrophes, initials, particles and number of words: no fragment stays."""
    for title, name in (("Frau", "Anna Maria Schmidt"), ("Señora", "María del Carmen Ruiz"), ("Mr", "John F. Kennedy"), ("Mr", "J.R.R. Tolkien"), ("Mr", "McDonald"),
                        ("Mr", "Lukáš Dvořák"), ("Dr", "O'Brien"), ("Dr.", "O’Brien-McKay"), ("Mr", "JOHN SMITH"), ("MR", "JOHN SMITH"), ("Herr", "Ludwig van der Rohe"),
                        ("Monsieur", "d'Artagnan"), ("Frau", "von Trapp"), ("Mr", "Nguyễn Văn An"), ("Dr", "Γιώργος Παπαδόπουλος"), ("Госпожа", "Ёлкина"), ("Mr", "Lukáš Novák")):
        for after in (" said so.", ", then", ".\nThe", ""):
            text = f"Then {title} {name}{after}"
            (start, end, kind, _), = pii.detect(text)
            assert text[start:end] == name and kind.startswith("name/"), (text, text[start:end])
    assert pii.detect("Mr and Mrs were out, Dr 5 of them") == []
    assert pii.detect("Mr Smith del todo")[0][3] == "smith"


def test_full_pools_are_widened(spark, monkeypatch):
    """Every surrogate of the pool is a real value: no draw within it can ever succeed."""
    monkeypatch.setattr(pii, "ROUNDS", 2)
    rows = [("email", f"{digit}@{letter}.org") for digit in range(10) for letter in "abcdefghijklmnopqrstuvwxyz"]
    out = pii.distinct_surrogates(spark.createDataFrame(rows, "kind string, value string")).collect()
    drawn = {r.drawn for r in out}
    assert len(out) == len(drawn) == len(rows) and not drawn & {v for _, v in rows}
    wide = pii.surrogate("email", "a@x.org", pii.WIDE)
    assert len(wide) == len("ab@x.org") and pii.written("email", "A@X.org", wide) == wide[:2].upper() + "@" + wide[3:4].upper() + ".org"
    assert [len(pii.surrogate("name/m/latin", "weber", n).split("-")[1]) for n in (1, pii.WIDE, pii.WIDE + 1)] == [3, 4, 5]
    assert pii.surrogate("ip", "192.168.1.1", pii.WIDE).startswith("10.") and pii.written("phone", "+49 30 1234", pii.surrogate("phone", "+49301234", pii.WIDE)).startswith("+49 ")
