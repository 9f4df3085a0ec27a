from pagemill.sources.web import SavedPages, Settings, seconds


def test_saved_pages(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_bytes(b"<p>\xff</p>")
    (tmp_path / "x.txt").write_text("no")
    spark.dataSource.register(SavedPages)
    rows = spark.read.format("saved_pages").option("path", str(tmp_path)).option("base", "https://h.example").load().collect()
    assert [(r.url, r.status_code) for r in rows] == [("https://h.example/d/a.html", 200)] and rows[0].html == "<p>�</p>"


def test_settings():
    s = Settings.load({"PAGEMILL_RATE_RPS": "2.5", "PAGEMILL_RATE_BURST": "x", "PAGEMILL_API_KEYS": " a, ,b", "PAGEMILL_ESCALATION_DELAYS": "1s,bad,500ms", "PAGEMILL_AUTH_ENABLED": "false", "PAGEMILL_MAX_TIMEOUT": "1m30s"})
    assert (s.rate_rps, s.rate_burst, s.api_keys, s.escalation_delays, s.auth_enabled, s.max_timeout) == (2.5, 10, ("a", "b"), (1.0, 0.5), False, 90.0)
    assert seconds("5") is None and seconds("") is None


def test_saved_pages_by_spark(spark, tmp_path):
    from pagemill.sources.web import saved_pages

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.html").write_bytes("<p>é</p>".encode() + b"\xff")
    (tmp_path / "y.HTM").write_text("y")
    (tmp_path / "z.txt").write_text("no")
    got = {r.url: (r.html, r.status_code) for r in saved_pages(spark, str(tmp_path), "https://h.example/").collect()}
    assert got == {"https://h.example/a/x.html": ("<p>é</p>\ufffd", 200), "https://h.example/y.HTM": ("y", 200)}


def test_settings_cover_the_service():
    from dataclasses import fields

    from pagemill.sources.web import Settings

    s = Settings.load({"PAGEMILL_PORT": "9", "PAGEMILL_HEADLESS": "f", "PAGEMILL_NAV_TIMEOUT": "1m", "PAGEMILL_MEM_THRESHOLD": "x", "PAGEMILL_API_KEYS": " , "})
    assert len(fields(Settings)) == 26 and (s.port, s.headless, s.nav_timeout, s.mem_threshold, s.api_keys) == (9, False, 60.0, 0.9, ())
