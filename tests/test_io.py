"""Sources, sinks, configuration and streaming."""

import json
import logging
import uuid

import pytest
from pyspark.sql import functions as F

from folio.config import Config, TextOptions, setup_logging
from folio.operators import label
from folio.operators.lines import to_lines
from folio.plans import pipelines
from folio.sinks import files as sinks
from folio.sources import files, ocr
from folio.streaming.documents import classify_stream, stream_texts


@pytest.fixture
def texts(tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "one.txt").write_text("Q1: What is it?\nAns: A thing.\n\nPage 3\n", encoding="utf-8")
    (folder / "two.txt").write_text("Question 2: hé?\n", encoding="utf-8")
    return folder


def test_text_files_to_reports(spark, texts, tmp_path):
    made = pipelines.classify_texts(spark, str(texts), str(tmp_path / "out"), folders=True)
    assert {r["name"]: len(r["questions"]) for r in made.collect()} == {"one": 1, "two": 1}
    found = list((tmp_path / "out/results/name=two").glob("part-*"))
    assert json.loads(found[0].read_text(encoding="utf-8"))["questions"][0]["text"] == "Question 2: hé?"
    asked = list((tmp_path / "out/questions/name=one").glob("part-*"))
    assert asked[0].read_text() == "Q1: What is it?\n\n"
    pipelines.classify_texts(spark, str(texts), str(tmp_path / "rows"))
    assert {(r["name"], r["at"], r["text"]) for r in spark.read.json(str(tmp_path / "rows/questions")).collect()} == {("one", 0, "Q1: What is it?"), ("two", 0, "Question 2: hé?")}
    assert {r["name"]: r["questions"][0]["text"] for r in spark.read.json(str(tmp_path / "rows/results")).collect()} == {"one": "Q1: What is it?", "two": "Question 2: hé?"}


def test_jsonl_and_csv_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, 'He said "yes, it is". And then  \nmore came of it.')], "doc_id long, text string")
    pipelines.full_text_pipeline(docs, str(tmp_path / "j"), str(tmp_path / "c"))
    assert {r["label"] for r in spark.read.json(str(tmp_path / "j")).collect()} == {""}
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()
    assert back[0]["text"] == 'He said"yes, it is".'
    sinks.write_csv(spark.createDataFrame([], "document_id long, id long, text string"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_recognition_seams(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"p1|p2||p4")
    (tmp_path / "b.png").write_bytes(b"image")
    (tmp_path / "c.png").write_bytes(b"bad")

    def render(content):
        yield from content.split(b"|")

    def read(image, prompt):
        if image == b"bad":
            raise ValueError("unreadable")
        return f"# {image.decode()}" if image else ""

    found = {r["path"][-5:]: r for r in ocr.extract(files.read_files(spark, str(tmp_path)), read, render).collect()}
    assert found["a.PDF"]["text"] == "--- PAGE 1 ---\np1\n\n--- PAGE 2 ---\np2\n\n--- PAGE 4 ---\np4"
    assert found["a.PDF"]["metadata"]["pages"] == 3
    assert (found["b.png"]["text"], found["b.png"]["metadata"]["source_type"]) == ("image", "image")
    assert (found["c.png"]["text"], found["c.png"]["metadata"]["extraction_success"]) == ("", False)
    limited = ocr.page_images(files.read_files(spark, str(tmp_path), "*.PDF"), render, 2)
    assert limited.count() == 2


def test_each_page_is_recognised_once(spark, tmp_path):
    """Two PDFs of two pages and an image: one rendering a PDF and one call a page, whatever is written from them."""
    calls = tmp_path / "calls"
    calls.mkdir()
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.pdf"):
        (tmp_path / "in" / name).write_bytes(f"Q1: What is {name}?|Ans: A file.".encode())
    (tmp_path / "in/c.png").write_bytes(b"Question 3: who?")

    def note(kind):
        (calls / f"{kind}-{uuid.uuid4()}").touch()

    def render(content):
        note("render")
        yield from content.split(b"|")

    def read(image, prompt):
        note("read")
        return image.decode()

    for output, folders in ((str(tmp_path / "out"), True), (str(tmp_path / "rows"), False), (None, False)):
        made = pipelines.read_and_classify(spark, str(tmp_path / "in"), read, output, render, folders=folders)
        assert {r["name"]: len(r["questions"]) for r in made.collect()} == {"a": 1, "b": 1, "c": 1}
        found = [p.name.split("-")[0] for p in calls.iterdir()]
        assert (found.count("render"), found.count("read")) == (2, 5)
        for p in calls.iterdir():
            p.unlink()
    text = (next((tmp_path / "out/extracted/name=a").glob("part-*"))).read_text()
    assert text == "--- PAGE 1 ---\nQ1: What is a.pdf?\n\n--- PAGE 2 ---\nAns: A file.\n"


def test_files_keep_the_order_of_their_list(spark, tmp_path):
    for name in ("1.png", "11.png", "x/1.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    given = [str(tmp_path / "11.png"), str(tmp_path / "x"), str(tmp_path / "1.png"), str(tmp_path / "11.png")]
    found = {bytes(r["content"]).decode(): r["source_ord"] for r in files.read_files(spark, given).collect()}
    assert found == {"11.png": 0, "x/1.png": 1, "1.png": 2}


def load_reader():
    LOADS.append(1)
    return lambda image, prompt: f"{image.decode()} {len(LOADS)}"


LOADS = []


def test_models_are_loaded_once():
    read, again = ocr.once_per_worker(load_reader), ocr.once_per_worker(load_reader)
    assert [read(b"a", ""), read(b"b", ""), again(b"c", "")] == ["a 1", "b 1", "c 1"]


def test_command_line(spark, texts, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "reader.py").write_text("def read(image, prompt):\n    return image.decode()\n")
    (tmp_path / "a.png").write_bytes(b"Q1: What is it?")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", f"{spark.sparkContext.environment['PYTHONPATH']}:{tmp_path}")
    assert pipelines.main([]) == 1
    assert pipelines.main(["--samples"]) == 0
    assert pipelines.main(["--text", str(texts), "-o", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o/results/name=one").is_dir()
    assert pipelines.main([str(tmp_path / "a.png"), "--ocr", "reader:read", "-o", str(tmp_path / "p"), "--rows"]) == 0
    assert spark.read.json(str(tmp_path / "p/questions")).first()["text"] == "Q1: What is it?"
    with pytest.raises(SystemExit):
        pipelines.main([str(tmp_path / "a.png")])
    assert "Storage Layer" in capsys.readouterr().out


def test_models_get_the_messages(spark):
    rows = spark.createDataFrame([(1, 0, "so it goes on and on")], "doc_id long, block_id long, text string")

    def reply(chats):
        assert [m["role"] for m in chats[0]] == ["system", "user"] and chats[0][1]["content"].endswith("so it goes on and on")
        return ["answer"] * len(chats)

    assert label.label_blocks(rows, reply_fn=reply, chat=True).first()["label"] == "answer"


def test_options_come_from_the_settings(spark, tmp_path):
    config = Config()
    config.tree["text_processing"] |= {"fix_duplicate": True, "remove_bounding_boxes": False}
    options = TextOptions.of(config)
    assert (options.fix_duplicate, options.remove_bounding_boxes, options.chunk_overlap) == (True, False, 50)
    docs = spark.createDataFrame([(1, "it was the,\nPage 2\nend of it.\n<|ref|>x")], "doc_id long, text string")
    kept = pipelines.full_text_pipeline(docs, options=options)[0]
    assert [r["line"] for r in kept.orderBy("line_idx").collect()] == ["it was the, end of it.", "<|ref|>x"]
    assert pipelines.text_to_jsonl(docs, str(tmp_path / "j")).first()["total_lines"] == 3
    assert pipelines.text_to_csv(docs, str(tmp_path / "c"), False).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["text"]


def test_images_in_memory(spark):
    images = spark.createDataFrame([(1, bytearray(b"image")), (2, None)], "doc_id long, content binary")
    found = {r["doc_id"]: r for r in ocr.extract(files.in_memory(images), lambda image, prompt: image.decode()).collect()}
    assert (found[1]["text"], found[1]["metadata"]["source_type"], found[1]["metadata"]["source_path"]) == ("image", "pil_image", None)
    assert (found[2]["text"], found[2]["metadata"]["source_type"]) == ("", "unknown")


def test_source_types(column):
    assert column(files.source_type, ["x.PDF", "y.png", None]) == ["pdf", "image", "unknown"]
    assert column(files.stem, ["/a/b.c.txt", "plain"]) == ["b.c", "plain"]


def test_stream_gives_the_batch_result(spark, texts, tmp_path):
    query = classify_stream(stream_texts(spark, str(texts), 1), str(tmp_path / "s"), str(tmp_path / "check"))
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "s")).drop("batch").orderBy("doc_id").collect()
    batch = pipelines.classify_documents(to_lines(files.read_texts(spark, str(texts)))).drop("timestamp").orderBy("doc_id").collect()
    assert streamed == batch


def test_configuration(tmp_path):
    config = Config(str(tmp_path / "absent.yaml"))
    assert (config.get("text_processing.chunk_overlap"), config.get("a.b", 3), config.get("ocr.model_name", "x")) == (50, 3, "x")
    assert TextOptions().similarity_threshold == 0.8
    yaml = pytest.importorskip("yaml")
    config.save(str(tmp_path / "c.yaml"))
    assert Config(str(tmp_path / "c.yaml")).tree == config.tree == yaml.safe_load((tmp_path / "c.yaml").read_text())


def test_logging(tmp_path):
    log = setup_logging(str(tmp_path / "logs"))
    log.info("hello")
    logging.shutdown()
    assert "hello" in next((tmp_path / "logs").glob("folio-*.log")).read_text()


def test_page_limit(spark):
    pages = spark.range(1, 6).select(F.lit(1).alias("doc_id"), F.col("id").alias("page_no"))
    assert [files.first_pages(pages, n).count() for n in (None, 0, 2)] == [5, 5, 2]
