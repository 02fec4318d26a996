"""The command line runs build, fold and load against the session."""

from lexidx.__main__ import main
from tests.conftest import write_lines


def test_cli_build_fold_load(spark, tmp_dir, capsys):
    src = write_lines(tmp_dir, ['{"title": "paper boats", "tag": "toys", "count": 8}'])
    main(["build", "--source", src, "--fields", "title:text,tag:keyword,count:long", "--root", f"{tmp_dir}/st",
          "--index", "idx", "--version", "1", "--version-id", "v-9", "--layout", "local", "--events", f"{tmp_dir}/ev"])
    main(["fold", "--events", f"{tmp_dir}/ev", "--out", f"{tmp_dir}/iv"])
    row = spark.read.parquet(f"{tmp_dir}/iv").collect()
    assert [(r.version_id, r.status, r.doc_count) for r in row] == [("v-9", "UPLOADED", 1)]
    main(["load", "--root", f"{tmp_dir}/st", "--index", "idx", "--version", "1", "--versions", f"{tmp_dir}/iv"])
    assert "LOADED" in capsys.readouterr().out
