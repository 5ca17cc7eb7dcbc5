import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import python_preprocess
from lexmill.plans import classify_files
from lexmill.sources import PLAIN, Loader, label_lines, line_index, write_labels
from lexmill.sources import corpus as corpus_module
from lexmill.storage import scratch_path, shared_dir


@pytest.fixture()
def files(tmp_path):
    data, labels = tmp_path / "data.txt", tmp_path / "labels.txt"
    data.write_text("red red blue\nblue green\ngreen\n")
    labels.write_text("AACAT\nBBCAT,M1,AACAT\nX\n")
    return str(data), str(labels)


def test_labelled_documents_are_dropped_and_copied(spark, rows, files):
    x, y = Loader(spark).read(*files, **PLAIN)
    assert rows(x, "doc_id", "true_label", "feature", "value") == [
        (0, "AACAT", "blue", 1.0),
        (0, "AACAT", "red", 2.0),
        (1, "AACAT", "blue", 1.0),
        (1, "AACAT", "green", 1.0),
        (1, "BBCAT", "blue", 1.0),
        (1, "BBCAT", "green", 1.0),
    ]
    assert rows(y, "doc_id", "true_label", "label") == [
        (0, "AACAT", "AACAT"),
        (1, "AACAT", "AACAT"),
        (1, "BBCAT", "BBCAT"),
    ]


def test_unlabelled_documents_are_all_kept(spark, rows, files):
    x, y = Loader(spark).read(files[0], **PLAIN)
    assert y is None
    assert rows(x.select("doc_id").distinct()) == [(0,), (1,), (2,)]


def test_line_numbers_do_not_depend_on_later_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"line {i}\n" for i in range(4000)))
    keys = ["spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes"]
    before = {k: spark.conf.get(k, None) for k in keys}
    lines = line_index(spark, str(path))
    assert {k: spark.conf.get(k, None) for k in keys} == before
    try:
        for key, value in [(keys[0], "64"), (keys[1], "700b"), (keys[1], "10m")]:
            spark.conf.set(key, value)
            assert sorted((r.line_no, r.value) for r in lines.collect()) == [(i, f"line {i}") for i in range(4000)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_part_files_follow_by_number(spark, rows, tmp_path):
    for number, text in (("100000", "b"), ("99999", "a"), ("100001", "c")):
        (tmp_path / f"part-{number}-x.txt").write_text(text + "\n")
    assert rows(line_index(spark, str(tmp_path))) == [(0, "a"), (1, "b"), (2, "c")]


def test_a_cluster_has_to_name_its_shared_folder(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, folder = "spark://host:7077", None
            getCheckpointDir = classmethod(lambda cls: cls.folder)
            setCheckpointDir = classmethod(lambda cls, folder: setattr(cls, "folder", folder))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Session.sparkContext.master = "local-cluster[3,2,1000]"
    with pytest.raises(RuntimeError):
        shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert shared_dir(Session) == Session.sparkContext.folder


def test_label_line_keeps_suffix_only(spark, rows):
    lines = spark.createDataFrame([(0, "CAT,A,ACATX,BCAT"), (1, "")], "line_no bigint, value string")
    assert rows(label_lines(lines)) == [(0, "BCAT"), (0, "CAT")]


def test_python_tokenizer_and_preprocess(spark, rows, files):
    class Letters:
        def tokenize(self, text):
            return text.split("e")

    x, _ = Loader(spark).read(
        files[0], tokenizer=Letters(), preprocess=python_preprocess(lambda w: "" if w == "n" else w.strip()), **PLAIN
    )
    assert rows(x.filter("doc_id = 0"), "feature", "value") == [("d blu", 1.0), ("d r", 1.0), ("r", 1.0)]


@pytest.mark.parametrize("one_task", [True, False])
def test_line_numbers_follow_files_and_splits(spark, tmp_path, monkeypatch, one_task):
    if not one_task:
        monkeypatch.setattr(corpus_module, "ONE_TASK_BLOCKS", 0)
    lines = [f"line {i} " + "x" * (i % 97) for i in range(5000)]
    # written so that listing order, size order and name order all differ
    for name, part in (("c", lines[4200:]), ("a", lines[:1000]), ("b", lines[1000:4200])):
        (tmp_path / f"{name}.txt").write_text("\n".join(part) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "500")
    try:
        found = dict(map(tuple, line_index(spark, str(tmp_path)).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [found[i] for i in range(len(lines))] == lines
    assert len(found) == len(lines)


def test_labels_are_written_in_key_order(spark, rows):
    labels = spark.range(1000).select((999 - F.col("id")).alias("doc_id"), F.concat(F.lit("L"), F.col("id")).alias("label"))
    path = scratch_path(spark, "out")
    write_labels(labels.repartition(7), path)
    back = dict(map(tuple, line_index(spark, path).collect()))
    assert [back[i] for i in range(1000)] == [f"L{999 - i}" for i in range(1000)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_classify_files_with_and_without_test_labels(spark, rows, tmp_path):
    data, labels = tmp_path / "d.txt", tmp_path / "l.txt"
    data.write_text("cat cat purr\ndog bark\ncat meow\ndog dog woof\n")
    labels.write_text("FELINECAT\nCANINECAT\nFELINECAT\nCANINECAT\n")
    scored = classify_files(spark, "nb", str(data), str(labels), str(data), str(labels), weight="once", reading=PLAIN)
    assert rows(scored) == [(4, 4, 1.0)]
    found = classify_files(spark, "nb", str(data), str(labels), str(data), weight="once", reading=PLAIN)
    assert rows(found, "doc_id", "label") == [(0, "FELINECAT"), (1, "CANINECAT"), (2, "FELINECAT"), (3, "CANINECAT")]


def test_default_reading(spark, rows, tmp_path):
    data = tmp_path / "d.txt"
    data.write_text("The caf&eacute; isn't walking &amp;&#x27; the WALKS &copy;right na&iuml;ve 42 x\n")
    assert rows(Loader(spark).read(str(data))[0], "feature", "value") == [("café", 1.0), ("isn", 1.0), ("naïv", 1.0), ("right", 1.0), ("walk", 2.0)]


def test_stop_words_and_stems(spark, rows, tmp_path):
    data = tmp_path / "d.txt"
    data.write_text("the walking walks the dog\n")
    stop = spark.createDataFrame([("the",)], "word string")
    for words in (stop, ["the"]):
        x, _ = Loader(spark).read(str(data), stop_words=words, stem=True)
        assert rows(x, "feature", "value") == [("dog", 1.0), ("walk", 2.0)]
