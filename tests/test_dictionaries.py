"""Dictionaries from small files."""

import json

from medialake.sources import dictionaries as D

CEDICT = """# CC-CEDICT
大阪 大阪 [Da4 ban3] /Osaka/Osaka prefecture/
京都 京都 [Jing1 du1] /Kyoto (city in Japan)/capital city, of old/
海 海 [hai3] /sea/
看見 看见 [kan4 jian4] /to see; to catch sight of/
這個 这个 [zhe4 ge5] /variant of 這箇|这个/(pronoun) the  one, this/
張三 张三 [Zhang1 San1] /surname Zhang/CL:個|个[ge4]/
ABC ABC [a] /alphabet/
京都 京都 [Jing1 du1] /later gloss/
没有/broken
"""


def test_cedict(spark, tmp_path):
    (tmp_path / "c.u8").write_text(CEDICT)
    found = {r.word: r.english for r in D.cedict(spark, str(tmp_path / "c.u8")).collect()}
    # Only a gloss in title case throughout is a name; the first other one goes before it.
    assert found == {"大阪": "osaka prefecture", "京都": "capital city", "看見": "see", "看见": "see", "這個": "one", "这个": "one"}


def test_cedict_empty(spark, tmp_path):
    (tmp_path / "c.u8").write_text("# nothing\n")
    assert D.cedict(spark, str(tmp_path / "c.u8")).count() == 0


def test_merged(spark, tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({" 海邊 ": "seaside", "É A": "shore", "abc": "abc", "山": "hill", "花園": "yard"}))
    (tmp_path / "over.json").write_text(json.dumps({"花園": "garden"}))
    base, over = (D.keyword_map(spark, str(tmp_path / f"{n}.json")) for n in ("base", "over"))
    assert {r.word: r.english for r in D.merged_dictionary(base, over).collect()} == {"海邊": "seaside", "É A": "shore", "é a": "shore", "花園": "garden"}
