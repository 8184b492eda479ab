import json
from datetime import date

import pytest

from weftline.config import load
from weftline.plans import log


def test_config_file(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"seeds": ["http://e.com"], "crawl": {"max_pages": 9}}))
    config, seeds = load(str(tmp_path / "c.json"))
    assert config.crawl.max_pages == 9 and seeds == ["http://e.com"] and load()[0].crawl.max_pages == 500


def test_daily_log(tmp_path):
    log.setup(folder=str(tmp_path), day=date(2020, 1, 2)).info("hello")
    assert "hello" in (tmp_path / "log_2020-01-02.log").read_text()


def test_errors_name_their_place():
    try:
        raise KeyError("x")
    except KeyError as e:
        with pytest.raises(log.JobError, match=r"reading: 'x' \(.*test_jobs_small.py:\d+\)"):
            raise log.JobError("reading", e)


def test_observed(spark):
    df, watch = log.observed(spark.createDataFrame([(1, None), (2, "e")], "a int, error string"), "pages")
    df.collect()
    assert watch.get == {"rows": 2, "failures": 1}
