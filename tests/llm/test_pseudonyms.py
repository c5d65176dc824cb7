"""Values beside other words and numbers, in several ways of writing."""

import re

from gleaner.llm import pii_feistel


def _new(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii_feistel.pseudonymised(frame, "k", count="n").orderBy("doc_id").collect()
    return [r.text for r in rows], [r.n for r in rows]


def test_values_end_where_they_end(spark):
    phone, iban = "+1 (017) 555-7713", "GB82 WEST 1234 5698 7654 32"
    ip = "97.51.17.173"
    new, n = _new(spark, phone, f"{phone} 2024", f"{phone} {ip}", ip, iban, f"{iban} IS", f"{iban} CALL 12", f"{phone} 123456789 12345", f"{phone} 123-45-6789",
                  f"+49 30 123456 {ip}", "+4930123456")
    assert n == [1, 1, 2, 1, 1, 1, 1, 1, 2, 2, 1]
    assert new[1] == f"{new[0]} 2024" and new[2] == f"{new[0]} {new[3]}" and new[0] != phone and new[3] != ip
    assert new[5] == f"{new[4]} IS" and new[6] == f"{new[4]} CALL 12" and new[4] != iban
    assert new[7] == f"{new[0]} 123456789 12345" and new[8].startswith(new[0] + " ") and "123-45-6789" not in new[8]
    assert new[9].endswith(f" {new[3]}") and re.sub("[^+0-9]", "", new[9].split(" " + new[3])[0]) == new[10]


def test_links_across_ways_of_writing(spark):
    new, n = _new(spark, "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "+351 912 345 678", "+351912345678", "+44 (0)20 7946 0958", "+44 20 7946 0958",
                  "+33 1 23 45 67 89 2024", "+33123456789")
    assert n == [1] * 8
    assert new[0].replace(" ", "") == new[1] and new[2].replace(" ", "") == new[3]
    assert new[4].replace("(0)", "") == new[5] and new[6].replace(" ", "") == new[7] + "2024"
    moved = new[1][4:] + new[1][:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def test_dates_day_first(spark):
    new, n = _new(spark, "25/12/1985", "1985-12-25", "12/25/1985", "31/02/1985", "13/13/1985")
    assert n == [1, 1, 1, 0, 0] and new[3:] == ["31/02/1985", "13/13/1985"]
    year, month, day = new[1].split("-")
    assert new[0] == f"{day}/{month}/{year}" and new[2] == f"{month}/{day}/{year}" and new[0] != "25/12/1985"


def test_names_in_other_letters(spark):
    names = ["łukasz", "čapek", "王小明", "ñandú", "ёлка", "ѓорѓи", "김철수"]
    new, n = _new(spark, *[f"{x}@mail.example.com" for x in names], "王小明@other.example.org")
    assert n == [1] * 8 and all(t.endswith(".com") for t in new[:7])
    assert not any(c in t.split("@")[0] for x, t in zip(names, new, strict=False) for c in re.findall("[łč王小明ѓ김철수]", x))
    assert new[2].split("@")[0] == new[7].split("@")[0] and len(set(new)) == 8
