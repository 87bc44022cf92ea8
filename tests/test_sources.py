"""Readers of rating files and harvested records."""

from shelfmark.plans import runs
from shelfmark.sources import oai, ratings_files, tables

PREFIXES = 'xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/"'


def record(name, stamp, sets=(), gone=False, /, **fields):
    """One harvested record; ``fields`` are metadata elements, lists for repeated ones, none for a record without metadata."""
    elements = "".join(
        f"<dc:{key}>{value}</dc:{key}>" for key, values in fields.items()
        for value in (values if isinstance(values, list) else [values]))
    body = f"<metadata><oai_dc:dc {PREFIXES}>{elements}</oai_dc:dc></metadata>" if fields else ""
    status = ' status="deleted"' if gone else ""
    specs = "".join(f"<setSpec>{s}</setSpec>" for s in sets)
    return f"<record><header{status}><identifier>{name}</identifier>{specs}<datestamp>{stamp}</datestamp></header>{body}</record>"


def response(*records):
    return f'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>{"".join(records)}</ListRecords></OAI-PMH>'


HARVEST = response(
    record("oai:lib:kites", "2023-11-02", ["level:school", "level:college", "shelf"], rights="open", language="en-GB",
           subject=["Wind", "Paper"], title="Kites and wind", identifier=["https://lib.example/kites", "urn:kites"],
           description="kites wind paper string sail kites wind", date="2023-10-30", type="Course"),
    record("oai:lib:sails", "2023-11-03", ["language:en", "grain_size:course"], identifier="https://lib.example/sails",
           title="Sails", description="sail wind boat string sail wind"),
    record("oai:lib:bare", "2023-11-04", ["language:en"]),
    record("oai:lib:lost", "2023-11-05", (), True),
)


def test_movies(spark, tmp_path):
    (tmp_path / "movies.dat").write_text("7::Sky (II) (1999)::Drama|War\n\nbroken line\n8::Sea (2001)::Comedy\n")
    got = {r.id: r for r in ratings_files.read_movies(spark, str(tmp_path / "movies.dat")).collect()}
    assert (got[7].name, got[7].year, got[7].genre) == ("Sky (II) ", 1999, "Drama|War")
    assert (got[8].name, got[8].year) == ("Sea ", 2001)
    assert got[None]._corrupt == "broken line" and len(got) == 3


def test_users_and_ratings(spark, tmp_path):
    (tmp_path / "users.dat").write_text("1::F::25::4\n2::M::old::7\n")
    users = {r.id: r for r in ratings_files.read_movie_users(spark, str(tmp_path / "users.dat")).collect()}
    assert (users[1].gender, users[1].age, users[1].occupation) == ("F", 25, 4) and users[2].age is None
    (tmp_path / "ratings.dat").write_text("1::5::3::978300760\n1::5::2\n")
    ratings = ratings_files.read_ratings(spark, str(tmp_path / "ratings.dat")).collect()
    assert sorted(map(tuple, ratings)) == [(1, 5, 2), (1, 5, 3)]


def test_oai_records(spark, tmp_path):
    (tmp_path / "harvest.xml").write_text(HARVEST)
    records = oai.read_oai_records(spark, str(tmp_path / "harvest.xml"))
    got = {r.identifier: r for r in records.collect()}
    assert len(got) == 4
    assert got["oai:lib:lost"].oai_identifier == "deleted" and got["oai:lib:lost"].title is None
    kites = got["oai:lib:kites"]
    assert (kites.status, kites.permalink, kites.title) == ("live", "https://lib.example/kites", "Kites and wind")
    assert kites.subject == ["Wind", "Paper"]
    bare = got["oai:lib:bare"]
    assert (bare.status, bare.title, bare.subject) == ("live", None, [])
    facets = {tuple(r) for r in oai.record_facets(records).collect()}
    assert facets == {
        ("oai:lib:kites", "level", "school"), ("oai:lib:kites", "level", "college"), ("oai:lib:kites", "shelf", None),
        ("oai:lib:sails", "language", "en"), ("oai:lib:sails", "grain_size", "course"), ("oai:lib:bare", "language", "en")}


def test_records_become_entries_and_tombstones_delete_them(spark, tmp_path):
    (tmp_path / "first.xml").write_text(HARVEST)
    (tmp_path / "second.xml").write_text(response(
        record("oai:lib:sails", "2023-12-01", (), True), record("oai:lib:unknown", "2023-12-01", (), True),
        record("oai:lib:masts", "2023-12-02", identifier="https://lib.example/masts", title="Masts", language="en")))
    stored = spark.createDataFrame([], tables.SCHEMAS["entries"])
    read = lambda name: oai.read_oai_records(spark, str(tmp_path / name))
    entries = runs.cut(runs.harvest(stored, oai.entries_from_records(read("first.xml"), stored, 7)))
    rows = {r.oai_identifier: r for r in entries.collect()}
    assert sorted(rows) == ["oai:lib:bare", "oai:lib:kites", "oai:lib:sails"] and sorted(r.id for r in rows.values()) == [1, 2, 3]
    assert {r.lang for r in rows.values()} == {"en"} and {r.feed_id for r in rows.values()} == {7}
    assert rows["oai:lib:sails"].grain_size == "course" and not rows["oai:lib:bare"].permalink_good
    after = {r.id: r for r in runs.harvest(entries, oai.entries_from_records(read("second.xml"), entries, 7)).collect()}
    assert sorted(after) == [1, 2, 3, 4]
    assert after[rows["oai:lib:sails"].id].oai_identifier == "deleted" and after[4].title == "Masts"


def test_tables_come_back_with_their_schema(spark, tmp_path):
    spark.createDataFrame([(1, "art")], "id bigint, name string").write.parquet(str(tmp_path / "subjects"))
    assert tables.load_tables(spark, str(tmp_path), ["subjects"])["subjects"].collect()[0].name == "art"
