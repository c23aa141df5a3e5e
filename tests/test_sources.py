"""Readers on hand-made files, and writers read back."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from vigilday.operators import labels, normalise, org
from vigilday.sources import cert, tables

FILES = {
    "logon.csv": """id,date,user,pc,activity
{L1},01/04/2010 06:49:00,AAA0001,PC-1,Logon
{L2},01/04/2010 18:30:00,AAA0001,PC-1,Logoff
{L3},2010-01-05 06:49:00,AAA0001,PC-1,Logon
{L4},01/05/2010 06:49:00,,PC-1,Logon
{L5},13/45/2010 06:49:00,BBB0002,PC-2,Logon
{L6},01/05/2010 23:59:59,BBB0002,PC-2,Logon
""",
    "device.csv": "id,date,user,pc,activity\n{D1},01/04/2010 20:00:00,AAA0001,PC-1,Connect\n",
    "file.csv": 'id,date,user,pc,filename,content\n{F1},01/04/2010 20:01:00,AAA0001,PC-1,a.doc,"one, two\nthree ""four"""\n',
    "email.csv": """id,date,user,pc,to,cc,bcc,from,size,attachments,content
{E1},01/04/2010 09:00:00,AAA0001,PC-1,x@d.com;y@d.com,z@d.com,,a@d.com,1200,2,hello there
{E2},01/04/2010 09:05:00,BBB0002,PC-2,x@d.com,,,b@d.com,bad,0,hi
""",
    "http.csv": """id,date,user,pc,url,content
{H1},01/04/2010 10:00:00,AAA0001,PC-1,http://jobs.example.com/a?b=c,career
{H2},01/04/2010 10:01:00,AAA0001,PC-1,not an address,career
""",
    "LDAP/2009-12.csv": """employee_name,user_id,email,role,business_unit,functional_unit,department,team,supervisor
A,AAA0001,a@d.com,Engineer,1,1,Research,T1,S
""",
    "LDAP/2010-02.csv": """employee_name,user_id,email,role,business_unit,functional_unit,department,team,supervisor
A,AAA0001,a@d.com,Manager,1,1,Sales,T1,S
""",
    "answers/insiders.csv": """dataset,scenario,details,user,start,end
4.2,1,x.csv,AAA0001,01/04/2010 19:00:00,01/05/2010 02:00:00
5.2,2,y.csv,BBB0002,01/04/2010 00:00:00,01/09/2010 00:00:00
""",
}


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        path = root / "cert-r4.2" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_bad_rows_are_set_aside(spark, raw):
    good, bad = normalise.split_valid(cert.read_log(spark, raw, "logon"))
    assert [r.id for r in good.orderBy("id").collect()] == ["{L1}", "{L2}", "{L6}"]
    assert [r.id for r in bad.orderBy("id").collect()] == ["{L3}", "{L4}", "{L5}"]
    assert good.filter("id = '{L6}'").first().ts == datetime(2010, 1, 5, 23, 59, 59)


def test_quoted_text_over_lines(spark, raw):
    row = cert.read_log(spark, raw, "file", multiline=True).first()
    assert row.content == 'one, two\nthree "four"' and row.filename == "a.doc"


def test_email_and_web_columns(spark, raw):
    first, second = cert.email_columns(cert.read_log(spark, raw, "email")).orderBy("id").collect()
    assert first.recipients == ["x@d.com", "y@d.com", "z@d.com"] and first.n_recipients == 3
    assert (first["size"], second["size"], second.n_recipients) == (1200.0, None, 1)
    web = cert.web_columns(cert.read_log(spark, raw, "http")).orderBy("id").collect()
    assert [r.host for r in web] == ["jobs.example.com", None]


def test_directory_month_and_role_in_force(spark, raw):
    directory = cert.read_directory(spark, raw)
    assert sorted(r.snapshot_month for r in directory.collect()) == ["2009-12", "2010-02"]
    ud = spark.createDataFrame(
        [("AAA0001", date(2009, 11, 30), 1), ("AAA0001", date(2010, 1, 31), 2), ("AAA0001", date(2010, 2, 1), 3),
         ("BBB0002", date(2010, 2, 1), 4)], "user_id string, day date, n int")
    known = org.attach_org(ud, directory, ["role", "department"]).orderBy("n").collect()
    assert [(r.role, r.department) for r in known] == [
        (None, None), ("Engineer", "Research"), ("Manager", "Sales"), (None, None)]


def test_answers_of_one_version(spark, raw):
    answers = cert.read_answers(spark, raw)
    assert [(r.user_id, r.scenario) for r in answers.collect()] == [("AAA0001", 1)]
    with pytest.raises(ValueError):
        cert.keep_version(spark.createDataFrame([("5.2",)], "dataset string"), "r4.2")


def test_window_over_midnight_labels_both_days(spark, raw):
    logs = {n: normalise.split_valid(cert.read_log(spark, raw, n))[0] for n in ("logon", "device")}
    logs["file"] = cert.read_log(spark, raw, "file", multiline=True)
    logs["email"] = cert.read_log(spark, raw, "email")
    logs["http"] = cert.read_log(spark, raw, "http")
    events = normalise.normalise(logs)
    assert events.columns == normalise.EVENT_COLUMNS and events.count() == 9
    labelled = labels.label_events(events, cert.read_answers(spark, raw))
    assert sorted(r.event_id for r in labelled.collect()) == ["{D1}", "{F1}"]
    days = labels.label_days(normalise.user_days(events), labelled)
    assert {(r.user_id, str(r.day)): (r.label, r.scenario) for r in days.collect()} == {
        ("AAA0001", "2010-01-04"): (1, 1), ("BBB0002", "2010-01-04"): (0, 0), ("BBB0002", "2010-01-05"): (0, 0)}


def test_salted_label_join_gives_the_same_rows(spark, raw):
    events = normalise.normalise({"device": cert.read_log(spark, raw, "device")})
    answers = cert.read_answers(spark, raw)
    assert rows(labels.label_events(events, answers)) == rows(labels.label_events(events, answers, max_rows=0))


def test_profile_counts_rows_users_and_insiders(spark, raw):
    logs = {n: normalise.split_valid(cert.read_log(spark, raw, n))[0].withColumnRenamed("user", "user_id") for n in ("logon", "email")}
    found = {r.log: (r.n_rows, r.n_users, r.n_insiders) for r in cert.profile(logs, cert.read_answers(spark, raw)).collect()}
    assert found == {"logon": (3, 2, 1), "email": (2, 2, 1)}


def test_interim_reads_only_the_months_and_logs_asked_for(spark, raw, tmp_path):
    logs = {n: normalise.split_valid(cert.read_log(spark, raw, n))[0] for n in ("logon", "device")}
    path = str(tmp_path / "interim")
    tables.write_interim(normalise.normalise(logs), path)
    kept = tables.read_interim(spark, path, months=["2010-01"], logs=["device"])
    assert [r.event_id for r in kept.collect()] == ["{D1}"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "device" in plan.split("PartitionFilters")[1][:120]
    assert tables.read_interim(spark, path, months=["2011-01"]).count() == 0


def test_alerts_replace_only_their_days(spark, tmp_path):
    path = str(tmp_path / "alerts")
    schema = "user_id string, day date, score double"
    tables.write_alerts(spark.createDataFrame([("a", date(2010, 1, 4), 1.0), ("a", date(2010, 1, 5), 2.0)], schema), path)
    tables.write_alerts(spark.createDataFrame([("b", date(2010, 1, 5), 3.0)], schema), path)
    assert rows(tables.read_alerts(spark, path).select("user_id", "day", "score")) == [
        ("a", date(2010, 1, 4), 1.0), ("b", date(2010, 1, 5), 3.0)]


def test_runs_keep_their_settings(spark, tmp_path):
    path = str(tmp_path / "runs")
    metrics = spark.createDataFrame([("fused", "pr_auc", 0.5)], "variant string, metric string, value double")
    tables.write_run(metrics, {"alpha": 0.5, "W": 14}, "20240101-0900-a", path)
    tables.write_run(metrics, {"alpha": 0.7}, "20240101-1000-b", path)
    tables.write_run(metrics, {"alpha": 0.9}, "20240101-1000-b", path)
    runs = {r.run_id: r.params for r in tables.read_runs(spark, path).collect()}
    assert runs == {"20240101-0900-a": {"alpha": "0.5", "W": "14"}, "20240101-1000-b": {"alpha": "0.9"}}


def test_unknown_processed_table_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.write_processed(str(tmp_path), other=spark.range(1))
    tables.write_processed(str(tmp_path), split=spark.range(1))
    assert tables.read_processed(spark, str(tmp_path), "split").select(F.max("id")).first()[0] == 0
