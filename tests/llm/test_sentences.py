from __future__ import annotations

import random

import numpy as np
import pytest

from carryover.llm import sentences as sn
from tests.conftest import rows

CASES = [
    ["The parser reads e.g. this, i.e. all.", "Next one."],
    ["Fig. 2 shows 19.2 % growth, cf. Sec. 1.9.", "J. Q. Yarselis (ed.) wrote chap. 2 in 2052.", "Why rename x.tar.gz?!", "iNotes-x starts small."],
    ['The memo said "Keep it. Do not merge it." and nobody objected.', '"It failed twice."', "Another."],
    ['"Is it approved?" asked the reviewer.', "He asked: 'Who owns it?' but got no reply."],
    ["Sync stalled… then it went on.", "Nobody knows why…", "The rule (which is old. Very old.) still holds.", "(See the appendix, p. 3.)", "5 of the files were skipped."],
    ["Stop!! the vault is read-only.", "Really?", "Yes!", "iNotes-x starts small."],
    ["It ends at 7 p.m.", "The U.S. copy of Quavith Inc. lags behind.", "Tags, etc. are kept.", "Kept notes, logs, etc.", "阅读清单移动了全部标签。"],
    ["Das gilt z. B. für x, d. h. für alle Ordner.", "Am 9. Mai lag der Wert bei 9.700,9 Punkten.", "Siehe Nr. 4 usw. im Ordner.", "„Ist es fertig?“, fragte das Team.", "Der Vermerk „Nicht löschen. Niemals.“ blieb stehen."],
    ["La note « Ne rien fusionner. Jamais. » reste en place.", "Pourquoi garder x.zip ?", "M. Crun garde env. 6 fiches, c.-à-d. tout le lot.", "Voir l'art. 5 al. 2 pour y."],
    ["El Sr. Yarz revisa aprox. 8 notas, p. ej. las de x.", "¡No toques nada!", "¿Por qué se guarda?"],
    ["Запись № 6 весит 9,9 МБ и т. д. по списку.", "Итог: метки и т. д.", "Пометка «Не трогать. Никогда.» осталась."],
    ["डॉ. Ultusk ने 1.8 एमबी की फ़ाइल देखी।", "नोट में लिखा है “मत मिटाओ। कभी नहीं।” और बस।"],
    ["قال الدليل: «لا تحذف. أبدا.» ثم سكت.", "هل اكتمل الملف؟", "كتب د. Vex الملاحظة رقم 7."],
]
TIGHT = [
    ["同期は止まった……が、また動いた。", "彼は「消さない。決して。」と書いた。", "（付録7を見よ。）", "「終わったか？」と係が聞いた。", "第9.8版は18.2MBある。"],
    ["他说：「不要合并。永远不要。」然后离开了。", "文件x.md为何还在？！", "（见附录第2页。）", "同步停了……后来又继续了。"],
]


def texts(value, chunk=sn.CHUNK_TOKENS):
    return [value[a:b] for a, b in sn.split(value, chunk)]


@pytest.mark.parametrize("parts", CASES)
@pytest.mark.parametrize("space", [" ", "  ", "\n", "\r\n", " ", " ", "\n\n"])
def test_sentences(parts, space):
    assert texts(space.join(parts)) == parts


@pytest.mark.parametrize("parts", TIGHT)
@pytest.mark.parametrize("space", ["", "\n", "\n\n"])
def test_scripts_without_spaces(parts, space):
    assert texts(space.join(parts)) == parts


def test_lines():
    assert texts("# What moved. Then?\n\n- One. Two\n- Three\nText here. More\ntext.\r\n\r\n2. Fig. 2 is it. Yes\n1) x\n  * y. z\n\n \n1 of the files.") == ["# What moved. Then?", "- One. Two", "- Three", "Text here.", "More\ntext.", "2. Fig. 2 is it. Yes", "1) x", "* y. z", "1 of the files."]
    assert texts("ไฟล์ x.md มีขนาด 12.6 เมกะไบต์ ผู้ตรวจถามว่า“เสร็จหรือยัง?”แล้วเดินออกไป สมุดรายวัน") == ["ไฟล์ x.md มีขนาด 12.6 เมกะไบต์", "ผู้ตรวจถามว่า“เสร็จหรือยัง?”แล้วเดินออกไป", "สมุดรายวัน"]
    assert texts("end.The next?Then 5.Dr. Who came.") == ["end.", "The next?", "Then 5.", "Dr. Who came."]
    assert texts("") == texts(" \n\n\t ") == []


def test_chunks_compose():
    rng = random.Random(2)
    body = "\n\n".join(rng.choice([" ", "\n"]).join(rng.choice(CASES)) for _ in range(60)) + "".join(TIGHT[0]) + '\n- "a. b'
    for chunk in (1, 2, 7, 64, 1000):
        assert texts(body, chunk) == texts(body)


def test_many_texts_in_one_stream(monkeypatch):
    rng = random.Random(3)
    bodies = [" ".join(rng.choice(CASES)) + rng.choice(["", ' "open', "\n- line", " etc"]) for _ in range(50)] + ["", " ", "- x", "ก ข"]
    owner, start, end = sn.split_all(bodies, 16)
    assert [(int(o), bodies[o][s:e]) for o, s, e in zip(owner, start, end, strict=True)] == [(k, t) for k, b in enumerate(bodies) for t in texts(b)]
    monkeypatch.setattr(sn, "GROUP_CHARS", 100)
    assert [k for a, b in sn._groups(bodies) for k in range(a, b)] == list(range(len(bodies)))


def test_transducer_is_minimal_and_equal():
    nxt, out = sn.transducer()
    rng = np.random.default_rng(2)
    for _ in range(50):
        classes = rng.integers(0, len(sn.CLASSES), 200)
        state, cuts = sn.START, []
        for c in classes:
            state, cut = sn.step(state, sn.CLASSES[c])
            cuts.append(cut)
        assert sn.outputs(classes, 7).tolist() == cuts
    assert len(np.unique(np.column_stack([nxt, out]), axis=0)) == len(nxt)


def test_prefix_scan():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 5, (37, 5)).astype(np.int16)
    state, expected = 0, []
    for row in f:
        expected.append(state)
        state = row[state]
    assert sn.prefix_states(f).tolist() == expected


def test_long_texts():
    for text in ("-" * 200_000, "a." * 100_000, "x" * 500_000, '"' * 50_000, "( " * 50_000, "Mr. " * 50_000, " " * 300_000 + "a", "1." * 100_000, "\r\n" * 100_000 + "b", "A. " * 60_000):
        spans = sn.split(text)
        assert all(a < b for a, b in spans)


def test_operator(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (1, "A b. C d.", "x"), (2, None, None), (3, "", None), (None, "Z", "y")], "start_pos bigint, text string, sentence string")
    got = sn.sentences(df, "start_pos", "text")
    assert got.columns == ["start_pos", "sentence_no", "sentence_start_pos", "end_pos", "sentence"]
    assert rows(got) == sorted([(1, 0, 1, 4, "A b."), (1, 1, 6, 9, "C d.")] * 2 + [(None, 0, 1, 1, "Z")], key=repr)
    assert sn.sentences(df.limit(0), "start_pos", "text").count() == 0
