"""Commands on small folders, and the functions for SQL."""

import json

from corpusloom import __main__ as C
from corpusloom.operators import sql_functions

GOOD = "ئەم ڕستەیە بۆ تاقیکردنەوەی پڕۆگرامەکەی من دەچێت ژمارە"


def test_commands(spark, tmp_path, capsys):
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.txt").write_text("\n".join(f"{GOOD} {'ئابپتجچ'[i]}{'حخدڕزژس'[-i]}." for i in range(7)), encoding="utf-8")
    C.main(["normalize", str(lines), f"{tmp_path}/n"])
    assert "| kept | 7 |" in capsys.readouterr().out and spark.read.text(f"{tmp_path}/n/sentences").count() == 7
    C.main(["sanitize", str(lines), f"{tmp_path}/s", "--threshold", "0.99"])
    assert "| kept | 7 |" in capsys.readouterr().out
    C.main(["generate", str(lines), f"{tmp_path}/g", "--target", "10", "--ratio", "0.5", "--rate", "0.6"])
    out = capsys.readouterr().out
    assert "| corrupted | 5 |" in out and "| clean_pairs | 5 |" in out and spark.read.text(f"{tmp_path}/g/src").count() == 10
    (tmp_path / "pairs.jsonl").write_text("\n".join(json.dumps({"source": f"s{i}", "target": f"t{i}", "errors": [{"type": "x"}] * (i % 3)}) for i in range(20)))
    C.main(["split", f"{tmp_path}/pairs.jsonl", f"{tmp_path}/p"])
    assert "| train | 16 | 80.0 |" in capsys.readouterr().out
    C.main(["statistics", f"{tmp_path}/pairs.jsonl", f"{tmp_path}/t"])
    assert "| x | 19 | 100.0 |" in capsys.readouterr().out
    for name, text in {"src": "a b\nc d", "ref": "a c\nc d", "hyp": "a c\nc d"}.items():
        (tmp_path / name).write_text(text)
    C.main(["evaluate", f"{tmp_path}/src", f"{tmp_path}/e", "--reference", f"{tmp_path}/ref", "--hypotheses", f"{tmp_path}/hyp"])
    assert "| 1 | 0 | 0 | 1.0 | 1.0 | 1.0 | 0.0 | 0.0 |" in capsys.readouterr().out
    C.main(["manifest", str(lines), f"{tmp_path}/m"])
    assert "| 1 |" in capsys.readouterr().out
    for n in (7, 7):  # again: nothing is new
        C.main(["collect", str(lines), f"{tmp_path}/c"])
        assert f"| {n} |" in capsys.readouterr().out
    sql_functions.register(spark)
    assert spark.sql("select m2_edits('a b', 'a c') as e").first().e[0].correction == "c"
