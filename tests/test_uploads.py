from veilscan.sources.values import read_key_values


def test_each_file_is_read_by_its_own_kind(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"a{k}.csv").write_text(f"key,value\nk{k},v{k}\nkey,value\nw{k};\"x y\"\n")
    (tmp_path / "plain.csv").write_text("\nm,n\n")
    (tmp_path / "lines.json").write_text('{"key": "j1", "value": 1}\n\n[{"key": "j2", "value": 2}]\n')
    (tmp_path / "document.json").write_text('\n[\n{"key": "d1",\n "value": "x"},\n{"key": "d2", "value": "y"}]\n')
    (tmp_path / "empty.csv").write_text("")
    found = sorted(tuple(r) for r in read_key_values(spark, str(tmp_path)).collect())
    want = [(f"k{k}", f"v{k}") for k in range(4)] + [(f"w{k}", "x y") for k in range(4)] + [("key", "value")] * 4
    assert found == sorted(want + [("m", "n"), ("j1", "1"), ("j2", "2"), ("d1", "x"), ("d2", "y")])
