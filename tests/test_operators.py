"""Catalog versions, trees, sources and streams on small fixtures."""

import http.server
import json
import os
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tessera.errors import BookmarkError, BookmarkNotFound, ExternalServiceError, FeatureUnavailable, FolderNotFound, MediaNotFound
from tessera.operators import catalog, listing, recommend, thumbs, trees
from tessera.plans.queries import BOOKMARK_FILE
from tessera.schemas import ITEMS, LISTING
from tessera.sources import assets, bookmarks, config, files, focus
from tessera.streaming import incremental

TREE = [
    ("cover.JPG", False), (".hidden.png", False), ("notes.txt", False), ("album", True), ("album/a.png", False), ("#travel", True), ("#travel/x.mp4", False),
    ("#travel/x_thumbnail.png", False), ("#travel/plain", True), ("#travel/plain/#2024", True), ("#travel/plain/#2024/y.webm", False), ("##deep ", True),
    ("##deep /q.gif", False), (".dir", True), (".dir/#t", True), (".dir/#t/z.gif", False), ("#", True), ("#/w.png", False),
]


def listed(spark, rows=TREE, root="/lib"):
    return spark.createDataFrame([(root, p, d, None if d else 10, None, True, True) for p, d in rows], LISTING)


def paths(df):
    return sorted(r.relative_path for r in df.collect())


def test_crawl(spark):
    rows = {r.relative_path: r for r in catalog.crawl(listed(spark)).collect()}
    assert sorted(rows) == ["##deep /q.gif", "#/w.png", "#travel/plain", "#travel/plain/#2024/y.webm", "#travel/x.mp4", "#travel/x_thumbnail.png", ".dir/#t/z.gif", "album", "cover.JPG", "notes.txt"]
    assert rows["#travel/plain/#2024/y.webm"].tags == ["travel", "2024"]
    assert rows["##deep /q.gif"].tags == ["deep"] and rows["#/w.png"].tags == []
    assert rows["album"].item_type == "folder" and rows["cover.JPG"].ext == "jpg" and rows["#travel/plain"].size_bytes is None


def test_versions(spark):
    empty, now = spark.createDataFrame([], ITEMS), F.lit("2024-01-01").cast("timestamp")
    one, counts = catalog.refresh(empty, listed(spark), "/lib", now)
    n = one.count()
    assert n == 10 and counts.first().asDict() == {"seen": 10, "inserted": 10, "skipped": 0, "removed": 0}
    two, counts = catalog.refresh(one, listed(spark), "/lib", now)
    assert two.count() == n and counts.first().asDict() == {"seen": 10, "inserted": 0, "skipped": 10, "removed": 0}
    less = [r for r in TREE if r[0] != "notes.txt"]
    three, counts = catalog.refresh(one, listed(spark, less), "/lib", now)
    assert counts.first().removed == 1 and "notes.txt" not in paths(three)
    other, counts = catalog.refresh(one, listed(spark, less, "/other"), "/other", now)
    assert counts.first().removed == 0 and other.count() == n + 9
    grown = listed(spark).withColumn("size_bytes", F.lit(99).cast("long"))
    assert catalog.refresh(one, grown, "/lib", now)[0].where("size_bytes = 99").count() == 0
    assert catalog.refresh(one, grown, "/lib", now, refresh_known=True)[0].where("size_bytes = 99").count() > 0


def test_unreadable_directories_spare_their_rows(spark):
    one, _ = catalog.refresh(spark.createDataFrame([], ITEMS), listed(spark), "/lib", F.current_timestamp())
    rows = [r for r in TREE if not r[0].startswith("#travel/plain/")]
    held = listed(spark, rows).withColumn("readable", F.col("relative_path") != "#travel/plain")
    assert "#travel/plain/#2024/y.webm" in paths(catalog.refresh(one, held, "/lib", F.current_timestamp())[0])
    assert "#travel/plain/#2024/y.webm" not in paths(catalog.refresh(one, listed(spark, rows), "/lib", F.current_timestamp())[0])


def test_thumbnail_scopes(spark):
    rows = spark.createDataFrame([("a", "/x", None, 0), ("b", "/x", "", 0), ("c", "/y", "old", 0)], "item_id string, library_root string, thumbnail_route string, updated_at int")
    filled = {r.item_id: r.thumbnail_route for r in catalog.fill_thumbnails(rows, F.lit("new"), F.lit(1)).collect()}
    assert filled == {"a": "new", "b": "new", "c": "old"}
    assert catalog.clear_thumbnails(rows, F.lit(1), "/x").where("changed").count() == 2
    assert catalog.clear_thumbnails(rows, F.lit(1)).where("thumbnail_route IS NOT NULL").count() == 0


def test_upsert_keeps_known_sub_type(spark):
    rows = spark.createDataFrame([("a", "special", "u1", 1), ("a", None, "u2", 2)], "id string, sub_type string, url string, seq int")
    assert catalog.upsert_latest(rows, "id", F.col("seq"), keep_known=("sub_type",)).first().asDict() == {"id": "a", "sub_type": "special", "url": "u2", "seq": 2}


def test_listing_and_details(spark):
    rows = listing.directory_listing(listed(spark), F.lit("")).collect()
    assert [r.name for r in rows] == ["#", "##deep ", "#travel", "album", "cover.JPG"]
    held = listed(spark)
    assert listing.file_detail(held, "cover.JPG", "image").first().mime_type == "image/jpeg"
    with pytest.raises(MediaNotFound):
        listing.file_detail(held, "cover.JPG", "video")
    tag = spark.createDataFrame([((None, " t ", None, "0", "7", None, None),)], "e struct<name:string,tag:string,title:string,count:string,itemCount:string,itemsCount:string,childCount:string>")
    name, count = listing.coalesce_tag(F.col("e"))
    assert tuple(tag.select(name.alias("a"), count.alias("b")).first()) == ("t", 7)
    made = spark.createDataFrame([("1", None, None), ("2", "n", "MP4"), ("3", "n", "mov")], "id string, name string, ext string")
    got = {r.id: r for r in listing.format_items(made, "/l").collect()}
    assert got["1"].url == "/serve_image//l/images/1.info/unknown.jpg" and got["2"].thumbnail_route.endswith("n_thumbnail.png")
    assert got["3"].thumbnail_route == got["3"].url and got["3"].media_type == "video"


def test_directory_cover_takes_files_before_directories(spark):
    rows = spark.createDataFrame([("a/z.png",), ("a/b/a.png",), ("a/b/c/0.mp4",), ("n.txt",)], "path string")
    assert {r.dir: r.path for r in thumbs.directory_first_media(rows).collect()} == {"": "a/z.png", "a": "a/z.png", "a/b": "a/b/a.png", "a/b/c": "a/b/c/0.mp4"}


def nodes(spark, tmp_path, text=BOOKMARK_FILE):
    path = tmp_path / "Bookmarks"
    path.write_text(text, encoding="utf-8")
    return bookmarks.read_nodes(spark, f"file://{path}")


def test_bookmarks(spark, tmp_path):
    flat = nodes(spark, tmp_path)
    order = F.array_position(F.array(*map(F.lit, ("bookmark_bar", "other", "synced", "mobile"))), F.col("root"))
    assert [r.id for r in flat.orderBy(order, "pos").collect()] == ["1", "5", "6", "7", "8", "9", "10", "2"]
    assert [r.id for r in trees.youtube_walk(flat).collect()] == ["6", "9"]
    assert trees.youtube_walk(flat, repeat_root=True).first().path_display == "Bar / Bar / Dev"
    folders = flat.where("type = 'folder'")
    leaves = trees.bookmark_leaves(flat).withColumn("hit", F.exists("labels", lambda x: F.lower(x).contains("dev")))
    assert {r.id: r.matched for r in trees.rollup(folders, leaves, F.col("hit")).collect()} == {"1": 2, "5": 2, "7": 1, "2": 0}
    shown = trees.folder_view(folders, leaves, "1", F.col("hit"))
    assert [(r.id, r.n) for r in shown.collect()] == [("5", 2)]
    assert sorted(r.id for r in trees.folder_view(folders, leaves, "1", F.lit(True)).collect()) == ["5", "9"]
    assert trees.resolve(folders, ["1", "5"]).first().name == "Dev"
    with pytest.raises(BookmarkNotFound):
        trees.resolve(folders, ["1", "77"])


def test_bad_bookmark_files(spark, tmp_path):
    with pytest.raises(BookmarkNotFound):
        bookmarks.read_nodes(spark, f"file://{tmp_path}/none")
    with pytest.raises(BookmarkError):
        nodes(spark, tmp_path, "{oops")


def test_focus_config(spark, tmp_path):
    modes, default = focus.normalise(spark, '{"default_mode": "x", "modes": [{"id": "Dev", "keywords": [" Spark ", "", 3]}, {"id": "dev"}, {"id": ""}, 4]}')
    assert [(r.id, r.label, r.keywords) for r in modes.collect()] == [("all", "全部書籤", []), ("dev", "Dev", ["Spark"])] and default == "all"
    for bad in (None, "{", "[]", '{"modes": 1}'):
        modes, default = focus.normalise(spark, bad)
        assert [r.id for r in modes.collect()] == ["all"] and default == "all"
    modes, default = focus.load(spark, f"file://{tmp_path}/none")
    assert focus.choose(modes, "zzz", default).first().id == "all"


def test_tree_depth_and_empty(spark):
    chain = spark.createDataFrame([(str(k), str(k - 1) if k else None, f"n{k}", 0) for k in range(12)], "id string, parent_id string, name string, pos int")
    flat = trees.flatten(chain)
    assert flat.agg(F.max("depth")).first()[0] == 11 and trees.ancestors(flat).count() == 78
    assert trees.flatten(chain.limit(0)).count() == 0


def test_listing_source(spark, tmp_path):
    for path, is_dir in TREE:
        full = tmp_path / path
        if is_dir:
            full.mkdir(parents=True, exist_ok=True)
        else:
            full.parent.mkdir(parents=True, exist_ok=True)
            full.write_bytes(b"0123456789")
    os.symlink(tmp_path / "gone", tmp_path / "dangling.png")
    rows = files.list_tree(spark, str(tmp_path))
    assert paths(rows) == sorted([*[p for p, _ in TREE], "dangling.png"])
    assert rows.where("NOT present").first().relative_path == "dangling.png"
    assert catalog.crawl(rows).count() == 11
    with pytest.raises(FolderNotFound):
        files.list_tree(spark, str(tmp_path / "none"))
    assert files.list_store(spark, f"file://{tmp_path}").count() == 8  # Spark skips names that begin with a dot


def test_assets(spark):
    folders = [{"id": "a", "name": "A", "children": [{"id": "b", "name": "B"}]}, {"id": "c", "name": "C"}]
    assert list(assets.folder_edges(folders)) == [("a", None, "A", 0), ("b", "a", "B", 0), ("c", None, "C", 1)]
    assert assets.values_of([" a", "a", "", {"tag": "b"}], ("name", "tag")) == ["a", "b"]
    assert assets.request("http://127.0.0.1:9", "/x", {"a": None})["status"] == "error"
    now = [0.0]
    calls = []
    up = assets.Availability({"x": lambda: calls.append(1) or True}, 60, lambda: now[0])
    assert up("x") and up("x") and len(calls) == 1
    now[0] = 61
    assert up("x") and len(calls) == 2
    rows = spark.createDataFrame([("1", "n", ["t"])], "id string, name string, tags array<string>")
    change = spark.createDataFrame([("1", "", ["u"])], "id string, name string, tags array<string>")
    assert assets.update_fields(rows, change).first().asDict() == {"id": "1", "name": "n", "tags": ["u"]}
    assert assets.add_items(rows, change.withColumn("name", F.lit("new"))).first().name == "new"


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.load_config(path) == config.DEFAULTS
    config.save_config(path, {"library_path": "/x"})
    assert config.load_config(path) == {"library_path": "/x", "bookmarks_path": ""}
    config.save_config(path, [1])
    with pytest.raises(ValueError):
        config.load_config(path)


def test_samples(spark):
    rows = spark.range(30).withColumnRenamed("id", "k")
    a, b = (sorted(r.k for r in recommend.sample(rows, 7, "s", "k").collect()) for _ in range(2))
    assert a == b and len(set(a)) == 7
    assert recommend.sample(rows, 50, "s", "k").count() == 30
    names = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, " "), (4, "z")], "id int, name string")
    assert [(r.prefix, r.id) for r in recommend.prefix_clusters(names, "name", "id", "s").collect()] == [("a", 1), ("a", 2)]


def test_similar_falls_back_to_folders(spark):
    rows = spark.createDataFrame([(k, f"n{k}", ["t"] if k < 3 else [], ["f"], k) for k in range(8)], "id int, name string, tags array<string>, folders array<string>, modified int")
    assert [r.id for r in recommend.similar_items(rows, 0, ["t"], ["f"], "s").collect()] == [1, 2]
    assert len(recommend.similar_items(rows, 0, ["none"], ["f"], "s").collect()) == 6
    assert recommend.similar_items(rows, 0, [], [], "s").count() == 0


def test_incremental_crawl(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "catalog", "state"))
    listed(spark, TREE[:5]).write.parquet(f"{source}/a")
    stream = incremental.read_listings(spark, f"{source}/*")
    incremental.fold_into(stream, out, state).awaitTermination()
    listed(spark).write.parquet(f"{source}/b")
    incremental.fold_into(stream, out, state).awaitTermination()
    assert spark.read.schema(ITEMS).parquet(f"{out}/v=0").count() == 3
    assert spark.read.schema(ITEMS).parquet(f"{out}/v=1").count() == 10


def test_asset_details(spark):
    schema = "id string, name string, ext string, file_name string, tags array<string>, folders array<string>, website string, note string"
    items = spark.createDataFrame([
        ("1", "clip", "MP4", None, [" a", "a", ""], None, "u", None), ("2", None, None, "x.webm", None, ["f"], None, "n"), ("3", "lost", "mp4", None, None, None, None, None),
        ("4", "pic", "png", "first.png", None, None, None, None), ("5", None, "mov", None, None, None, None, None),
    ], schema)
    paths = ["/l/images/1.info/clip.mp4", "/l/images/1.info/clip_thumbnail.png", "/l/images/2.info/x.webm", "/l/images/4.info/pic.png", "/l/images/4.info/first.png", "/l/images/5.info/other.mkv"]
    files_ = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.id: r for r in listing.asset_details(items, files_, "/l", "video").collect()}
    assert sorted(got) == ["1", "2", "5"]
    assert got["1"].thumbnail_route == "/serve_image//l/images/1.info/clip_thumbnail.png" and got["1"].tags == ["a"]
    assert got["2"].ext == "webm" and got["2"].name == "x.webm" and got["2"].thumbnail_route == "/static/default_video_thumbnail.svg"
    assert got["5"].path.endswith("other.mkv")
    image = listing.asset_details(items, files_, "/l", "image").collect()
    assert [(r.id, r.path) for r in image] == [("4", "/l/images/4.info/first.png")]


class Service(http.server.BaseHTTPRequestHandler):
    """A stub of the asset service with 23 items; keeps what it is asked."""

    items = [{"id": f"i{k}", "name": f"n{k}", "ext": "png", "btime": 1700000000000 + k, "lastModified": "2024-01-02T03:04:05", "tags": ["t"]} for k in range(23)]
    asked: list = []

    def do_GET(self):  # noqa: N802
        path, _, query = self.path.partition("?")
        named = dict(urllib.parse.parse_qsl(query))
        self.asked.append((path, named))
        data = {
            "/api/item/list": lambda: self.items[int(named["offset"]) : int(named["offset"]) + int(named["limit"])],
            "/api/folder/list": lambda: [{"id": "a", "name": "A", "children": [{"id": "b", "name": "B"}]}], "/api/folder/listRecent": lambda: [{"id": "b", "name": "B"}],
            "/api/tag/list": lambda: ["x"], "/api/application/info": lambda: {"version": "1"}, "/api/library/info": lambda: {"library": {"path": "/lib"}, "folders": []},
            "/api/item/info": lambda: self.items[3] if "id" in named else None,
        }.get(path, lambda: None)()
        self.answer({"status": "success", "data": data} if data is not None else {"status": "error", "data": "unknown"})

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append((self.path, body))
        self.answer({"status": "success", "data": body})

    def answer(self, body):
        data = json.dumps(body).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_connector_reads_all_pages(spark, service):
    rows = assets.read_items(spark, service, limit="5", orderby="CREATEDATE").orderBy("pos").collect()
    assert [r.id for r in rows] == [f"i{k}" for k in range(23)] and [r.pos for r in rows] == list(range(23))
    assert rows[0].modified.year == 2024 and rows[1].created > rows[0].created
    assert {int(q["offset"]) for p, q in Service.asked if q.get("limit") == "5"} == {0, 5, 10, 15, 20}
    assert all(q["orderBy"] == "CREATEDATE" for p, q in Service.asked if p == "/api/item/list")
    assert assets.read_items(spark, service, limit="5", pages="2").count() == 10
    reader = assets.ItemReader({"base": service, "limit": "23"})
    assert len(list(reader.read(reader.partitions()[0]))) == len(list(reader.read(reader.partitions()[0]))) == 23


def test_service_calls(spark, service):
    assert assets.folder_table(spark, service).count() == 2 and assets.folder_list(service, recent=True)[0]["id"] == "b"
    assert assets.top_folders(assets.folder_list(service)) == [("a", "A", "/assets/folder/a/")]
    assert assets.tag_list(service) == ["x"] and assets.application_info(service)["version"] == "1" and assets.library_path(service) == "/lib"
    assert assets.item_info(service, "i3")["name"] == "n3"
    assert [q for p, q in Service.asked if p == "/api/item/info"] == [{"itemId": "i3"}, {"id": "i3"}]
    assert assets.create_folder(service, "new") == {"folderName": "new"}
    assert assets.rename_folder(service, "a", "z") == {"folderId": "a", "newName": "z"}
    assert assets.update_folder(service, "a", description="d", color="") == {"folderId": "a", "newDescription": "d"}
    assert assets.add_from_url(service, "u", "a", tags=["t"]) == {"url": "u", "folderId": "a", "tags": ["t"]}
    assert assets.add_from_urls(service, [{"url": "u"}])["items"] == [{"url": "u"}]
    assert assets.add_bookmark(service, "u", "n") == {"url": "u", "name": "n"} and assets.update_item_tags(service, "i", ["t"])["tags"] == ["t"]
    with pytest.raises(ExternalServiceError):
        assets.data_of(assets.request(service, "/api/none"))
    with pytest.raises(ExternalServiceError):
        assets.library_path("http://127.0.0.1:9")


def test_pages_are_fetched(spark, service):
    from tessera.sources import web

    rows = spark.createDataFrame([(f"{service}/api/tag/list",), ("http://127.0.0.1:9/x",), (None,), ("file:///etc/hosts",), ("http://",)], "url string")
    got = {r.url: r.bytes for r in web.fetch(rows, 2).collect()}
    assert json.loads(bytes(got.pop(f"{service}/api/tag/list")))["data"] == ["x"] and set(got.values()) == {None} and len(got) == 4


def test_feature_gate():
    up = {"x": False}
    gate = assets.Availability({"x": lambda: up["x"]}, 0)
    page = assets.needs("x", gate)(lambda n: n + 1)
    with pytest.raises(FeatureUnavailable):
        page(1)
    up["x"] = True
    assert page(1) == 2


def test_focus_file_is_created(spark, tmp_path):
    path = tmp_path / "conf" / "modes.json"
    modes, default = focus.load(spark, f"file://{path}")
    assert default == "all" and [r.id for r in modes.collect()] == ["all"]
    assert json.loads(path.read_text(encoding="utf-8"))["modes"][0]["label"] == "全部書籤"
    path.write_text('{"default_mode": "\\u3000DEV\\t", "modes": [{"id": "dev"}]}', encoding="utf-8")
    assert focus.load(spark, f"file://{path}")[1] == "dev"
    path.write_text("{bad", encoding="utf-8")
    assert focus.load(spark, f"file://{path}")[1] == "all" and path.read_text() == "{bad"


def test_roots_without_names_and_paths_through_leaves(spark, tmp_path):
    text = '{"roots": {"bookmark_bar": {"id": "1", "type": "folder", "children": [{"id": "3", "type": "url", "name": "u", "url": "http://u"}]}, "other": {"id": "2", "type": "folder"}}}'
    flat = nodes(spark, tmp_path, text)
    assert {r.id: r.labels[0] for r in flat.collect()} == {"1": "Bookmarks", "3": "Bookmarks", "2": "other"}
    folder = F.col("type") == "folder"
    assert trees.resolve(flat, ["1"], folder).count() == 1
    with pytest.raises(BookmarkNotFound):
        trees.resolve(flat, ["1", "3"], folder)


def test_focus_stats_of_a_folder(spark, tmp_path):
    flat = nodes(spark, tmp_path)
    leaves = trees.bookmark_leaves(flat)
    assert leaves.where("leaf_id = '10'").count() == 0  # no URL
    row = trees.focus_stats(flat.where("type = 'folder'"), leaves, "1", F.col("name").contains("Deep"), "Dev").first()
    assert (row.total_bookmarks, row.matched_bookmarks, row.matched_including_subfolders, row.has_results) == (1, 0, 1, False)
    assert row.description == "🎯 Dev 專注模式｜本層 0 / 1 筆，含子層 1 筆，目前沒有符合的書籤"


def test_thumbnails_are_stored(spark, tmp_path):
    rows = [("a", b"png", "image/png", "u", "youtube"), ("b", b"x", None, "http://h/p.WEBP?x", "bookmark"), ("c", None, None, "u", "bookmark"), ("d", b"", None, "u", "bookmark")]
    frame = spark.createDataFrame(rows, "media_id string, bytes binary, content_type string, url string, source string")
    got = {r.media_id: r.local_path for r in thumbs.store_thumbnails(frame, f"file://{tmp_path}/t").collect()}
    assert got == {"a": f"file://{tmp_path}/t/a.png", "b": f"file://{tmp_path}/t/b.webp"}
    assert (tmp_path / "t" / "a.png").read_bytes() == b"png"


def test_numbers_of_requests():
    from tessera.functions.scalars import parse_int

    assert parse_int(None, 30) == 30 and parse_int(" 7 ", 30) == 7
    with pytest.raises(ValueError):
        parse_int("x", 1)


def test_a_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    from tessera import session

    class Named:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        session.shared_folder(Named)
