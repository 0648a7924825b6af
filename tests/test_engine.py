"""The behaviour that users of the dialect rely on: each test is a small story."""

import pytest

from quillspark.engine import Engine
from quillspark.errors import ConstraintViolation, EngineError, SchemaError, SqlParseError, TransactionError, TriggerError, UnsupportedError


def test_create_insert_select(run):
    run("CREATE TABLE members (id INTEGER PRIMARY KEY, name TEXT NOT NULL, age INTEGER, email TEXT UNIQUE)")
    assert run("INSERT INTO members (id, name, age, email) VALUES (1, 'Ines', 51, 'ines@mail.test')") == 1
    assert run("SELECT * FROM members WHERE id = 1") == [(1, "Ines", 51, "ines@mail.test")]


def test_order_and_reals(run):
    run("CREATE TABLE tools (id INTEGER PRIMARY KEY, name TEXT, price REAL)")
    assert run("INSERT INTO tools VALUES (1, 'Anvil', 310.5), (2, 'Awl', 4.25)") == 2
    assert run("SELECT name FROM tools ORDER BY price") == [("Awl",), ("Anvil",)]
    assert run("SELECT name FROM tools WHERE price > 100") == [("Anvil",)]


def test_update_delete(run):
    run("CREATE TABLE members (id INTEGER PRIMARY KEY, name TEXT, age INTEGER)")
    run("INSERT INTO members VALUES (1, 'Dave', 40)")
    assert run("UPDATE members SET age = 41 WHERE id = 1") == 1
    assert run("SELECT age FROM members WHERE id = 1") == [(41,)]
    assert run("DELETE FROM members WHERE id = 1") == 1
    assert run("SELECT * FROM members") == []
    assert run("UPDATE members SET age = 1") == 0 and run("DELETE FROM members") == 0


def test_audit_trigger(run):
    run("CREATE TABLE members (id INTEGER PRIMARY KEY, name TEXT, age INTEGER)")
    run("CREATE TABLE audit (id INTEGER PRIMARY KEY, what TEXT, was TEXT, now TEXT)")
    run("CREATE TRIGGER a AFTER UPDATE ON members FOR EACH ROW BEGIN INSERT INTO audit (what, was, now) VALUES ('UPDATE', OLD.name, NEW.name); END")
    run("INSERT INTO members VALUES (1, 'Ines', 51), (2, 'Omar', 22)")
    run("UPDATE members SET name = name || 'x'")
    assert run("SELECT * FROM audit ORDER BY id") == [(1, "UPDATE", "Ines", "Inesx"), (2, "UPDATE", "Omar", "Omarx")]


def test_conflicts(run):
    run("CREATE TABLE stock (id INTEGER PRIMARY KEY, code TEXT UNIQUE, n INTEGER)")
    run("INSERT INTO stock VALUES (1, 'a', 10), (2, 'b', 20)")
    assert run("INSERT INTO stock VALUES (3, 'b', 1), (4, 'c', 2), (5, 'c', 3), (6, NULL, 4), (7, NULL, 5) ON CONFLICT (code) DO NOTHING") == 3
    assert run("SELECT * FROM stock ORDER BY id") == [(1, "a", 10), (2, "b", 20), (4, "c", 2), (6, None, 4), (7, None, 5)]
    assert run("INSERT INTO stock VALUES (8, 'a', 5), (9, 'd', 6) ON CONFLICT (code) DO UPDATE SET n = stock.n + excluded.n, id = id") == 2
    assert run("SELECT * FROM stock WHERE code IN ('a', 'd') ORDER BY id") == [(1, "a", 15), (9, "d", 6)]
    assert run("INSERT INTO stock SELECT id, code, 99 FROM stock WHERE code IS NOT NULL ON CONFLICT (id) DO UPDATE SET n = excluded.n WHERE stock.n > 10") == 2
    assert run("SELECT id, n FROM stock WHERE n = 99 ORDER BY id") == [(1, 99), (2, 99)]
    assert run("INSERT INTO stock VALUES (2, 'z', 0) ON CONFLICT (id) DO UPDATE SET code = ?", ["y"]) == 1
    assert run("SELECT code FROM stock WHERE id = 2") == [("y",)]
    with pytest.raises(ConstraintViolation):  # the other key still holds
        run("INSERT INTO stock VALUES (1, 'new', 0), (50, 'a', 0) ON CONFLICT (id) DO NOTHING")
    with pytest.raises(ConstraintViolation):
        run("INSERT INTO stock VALUES (1, 'p', 0), (1, 'q', 0) ON CONFLICT (id) DO UPDATE SET n = 0")
    with pytest.raises(SchemaError):
        run("INSERT INTO stock VALUES (1, 'p', 0) ON CONFLICT DO NOTHING")
    with pytest.raises(SchemaError):
        run("INSERT INTO stock VALUES (1, 'p', 0) ON CONFLICT (n) DO NOTHING")


def test_conflicts_fire_triggers_and_roll_back(engine, run):
    run("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER)")
    run("CREATE TABLE log (what TEXT, id INTEGER)")
    run("CREATE TRIGGER i AFTER INSERT ON t BEGIN INSERT INTO log VALUES ('i', NEW.id); END")
    run("CREATE TRIGGER u AFTER UPDATE ON t BEGIN INSERT INTO log VALUES ('u', NEW.id); END")
    run("INSERT INTO t VALUES (1, 1)")
    tx = engine.begin(0)
    engine.query(0, "INSERT INTO t VALUES (1, 5), (2, 6) ON CONFLICT DO UPDATE SET n = excluded.n", tx_id=tx)
    assert run("SELECT * FROM t ORDER BY id") == [(1, 5), (2, 6)]
    assert run("SELECT * FROM log ORDER BY what, id") == [("i", 1), ("i", 2), ("u", 1)]
    engine.rollback(tx)
    assert run("SELECT * FROM t") == [(1, 1)] and run("SELECT * FROM log") == [("i", 1)]


def test_conflicts_leave_rowids_apart(run):
    run("CREATE TABLE s (code TEXT UNIQUE, n INTEGER)")
    run("INSERT INTO s VALUES ('a', 1)")
    assert run("INSERT INTO s VALUES ('a', 2), ('a', 3), ('b', 4), ('c', 5) ON CONFLICT DO NOTHING") == 2
    run("INSERT INTO s VALUES ('d', 6), ('e', 7), ('f', 8)")
    assert run("DELETE FROM s WHERE n >= 6") == 3
    assert run("SELECT * FROM s ORDER BY n") == [("a", 1), ("b", 4), ("c", 5)]


def test_conflicts_in_triggers(run):
    run("CREATE TABLE t (id INTEGER PRIMARY KEY, kind TEXT)")
    run("CREATE TABLE kinds (kind TEXT PRIMARY KEY, first INTEGER)")
    run("CREATE TABLE counts (kind TEXT PRIMARY KEY, n INTEGER)")
    run("CREATE TRIGGER a AFTER INSERT ON t BEGIN INSERT INTO kinds VALUES (NEW.kind, NEW.id) ON CONFLICT (kind) DO NOTHING; END")
    run("CREATE TRIGGER b AFTER INSERT ON t BEGIN INSERT INTO counts VALUES (NEW.kind, 1) ON CONFLICT (kind) DO UPDATE SET n = counts.n + excluded.n; END")
    run("INSERT INTO t VALUES (1, 'x'), (2, 'y'), (3, 'x')")
    run("INSERT INTO t VALUES (4, 'y')")
    assert run("SELECT * FROM kinds ORDER BY kind") == [("x", 1), ("y", 2)]
    assert run("SELECT * FROM counts ORDER BY kind") == [("x", 2), ("y", 2)]
    run("CREATE VIEW v AS SELECT id, kind FROM t")
    run("CREATE TRIGGER c INSTEAD OF INSERT ON v BEGIN INSERT INTO kinds VALUES (NEW.kind, 0); END")
    with pytest.raises(UnsupportedError):
        run("INSERT INTO v VALUES (9, 'z') ON CONFLICT (id) DO NOTHING")


def test_truncate(engine, run):
    run("CREATE TABLE p (id INTEGER PRIMARY KEY)")
    run("CREATE TABLE c (id INTEGER, p INTEGER REFERENCES p (id))")
    run("INSERT INTO p VALUES (1), (2)")
    run("INSERT INTO c VALUES (1, 2)")
    with pytest.raises(ConstraintViolation):
        run("TRUNCATE TABLE p")
    tx = engine.begin(0)
    assert engine.query(0, "TRUNCATE c", tx_id=tx).affected_rows == 1
    assert run("SELECT * FROM c") == [] and run("TRUNCATE TABLE c") == 0
    engine.rollback(tx)
    assert run("SELECT * FROM c") == [(1, 2)]
    run("DELETE FROM c")
    assert run("TRUNCATE TABLE p") == 2 and run("SELECT * FROM p") == []
    with pytest.raises(SchemaError):
        run("TRUNCATE TABLE nowhere")


def test_fetch(run):
    run("CREATE TABLE t (id INTEGER)")
    run("INSERT INTO t VALUES (1), (2), (3), (4)")
    assert run("SELECT id FROM t ORDER BY id FETCH FIRST 2 ROWS ONLY") == [(1,), (2,)]
    assert run("SELECT id FROM t ORDER BY id OFFSET 1 ROW FETCH NEXT ROW ONLY") == [(2,)]
    with pytest.raises(EngineError):
        run("SELECT id FROM t ORDER BY id FETCH FIRST 2 ROWS WITH TIES")


def test_match_operator(run):
    run("CREATE VIRTUAL TABLE notes USING fts5(content, id)")
    run("INSERT INTO notes VALUES ('green pears ripen', 1), ('red pears', 2), (NULL, 3)")
    assert run("SELECT id FROM notes WHERE notes MATCH 'pears green'") == [("1",)]
    assert run("SELECT id FROM notes WHERE content MATCH ?", ["pears"]) == [("1",), ("2",)]
    assert run("SELECT n.id FROM notes n WHERE NOT n.content MATCH 'red' AND n MATCH 'pears'") == [("1",)]
    assert run("SELECT id FROM notes WHERE content NOT MATCH 'green' AND content IS NOT NULL") == [("2",)]
    assert run("SELECT id match FROM notes WHERE id = '2'") == [("2",)]
    run("DELETE FROM notes WHERE notes MATCH 'red'")
    assert run("SELECT COUNT(*) FROM notes") == [(2,)]


def test_views(run):
    run("CREATE TABLE members (id INTEGER PRIMARY KEY, name TEXT, age INTEGER)")
    run("INSERT INTO members VALUES (1, 'Ines', 51), (2, 'Kid', 7)")
    run("CREATE VIEW adults AS SELECT name, age FROM members WHERE age >= 18")
    assert run("SELECT * FROM adults") == [("Ines", 51)]
    assert run("SELECT u.id, a.age FROM members u JOIN adults a ON u.name = a.name") == [(1, 51)]
    run("CREATE VIEW named (who) AS SELECT name FROM adults")
    assert run("SELECT who FROM named") == [("Ines",)]
    run("DROP VIEW named")
    with pytest.raises(SchemaError):
        run("SELECT * FROM named")
    run("DROP VIEW IF EXISTS named")


def test_json(run):
    run("CREATE TABLE docs (id INTEGER PRIMARY KEY, data TEXT)")
    run("""INSERT INTO docs VALUES (1, '{"name":"Ines","age":51,"tags":["a",{"b":2}]}')""")
    assert run("SELECT json_extract(data, '$.name') AS name FROM docs WHERE json_extract(data, '$.age') > 18") == [("Ines",)]
    for path in ("$.tags[1].b", "$.tags.[1].b", "tags[1].b"):
        assert run(f"SELECT json_extract(data, '{path}') FROM docs") == [("2",)]
    assert run("SELECT json_array(1, 'a\"b', NULL, 2.5), json_object('b', 1, 'a', json_array('x'), 'b', 2) FROM docs") == [('[1,"a\\"b",null,2.5]', '{"a":["x"],"b":2}')]
    assert run("SELECT json_set('{\"a\":{\"x\":1}}', '$.a.y', 'z'), json_set('[1,2]', '[1]', 5), json_set('[1]', '[4]', 5), json_set('{}', 'p.q', NULL)") == [('{"a":{"x":1,"y":"z"}}', "[1,5]", None, '{"p":{"q":null}}')]


def test_full_text(run, engine):
    run("CREATE VIRTUAL TABLE articles USING fts5(content, note)")
    run("INSERT INTO articles VALUES ('The heavy rain fell upon the quiet harbour', 'n')")
    run("INSERT INTO articles (content) VALUES ('The old boats leave heavily laden'), ('Heavy heavy harbour'), (NULL)")
    assert run("SELECT count(*) FROM articles WHERE fts_match('articles', 'heavy')") == [(2,)]
    assert run("SELECT content FROM articles WHERE fts_match(articles, ?)", ["heavy quiet"]) == [("The heavy rain fell upon the quiet harbour",)]
    assert run("SELECT count(*) FROM articles a WHERE fts_match(a, 'the of') OR NOT fts_match(a, 'heavy')") == [(2,)]
    assert run("SELECT count(*) FROM articles a JOIN articles b ON a.content = b.content WHERE fts_match(a, 'harbour')") == [(2,)]
    assert [r["content"][:5] for r in engine.fts_search(0, "articles", "heavy rain").collect()] == ["The h", "Heavy"]
    assert run("DELETE FROM articles WHERE fts_match('articles', 'boats')") == 1


def test_full_text_terms_follow_changes(run, engine):
    run("CREATE VIRTUAL TABLE notes USING fts5(body, tag)")
    for body in ("copper kettle boils", "copper wire and wire", "paper kite"):
        run("INSERT INTO notes VALUES (?, 't')", [body])
    run("INSERT INTO notes VALUES (NULL, 'none')")
    table = engine.database(0).tables["notes"]

    def bodies(where, *params):
        got = sorted(r[0] or "" for r in run(f"SELECT body FROM notes WHERE {where}", params))
        assert got == sorted(r[0] or "" for r in run(f"SELECT body FROM notes WHERE {where} OR (NOT TRUE)", params)), "the scan says the same"
        return got

    def files(*queries):
        return len(engine.files_having(table, list(queries)))

    assert files("copper") == 2 and files("copper wire") == 1 and files("copper", "wire") == 1 and files("kettle kite") == 0 and files("the of") == 0
    assert bodies("fts_match(notes, 'copper')") == ["copper kettle boils", "copper wire and wire"]
    assert bodies("fts_match(notes, ?) AND tag = 't' AND fts_match(notes, ?)", "wire", "copper") == ["copper wire and wire"]
    assert run("UPDATE notes SET body = 'tin kettle' WHERE fts_match(notes, 'kettle')") == 1
    assert bodies("fts_match(notes, 'copper')") == ["copper wire and wire"] and bodies("fts_match(notes, 'tin')") == ["tin kettle"]
    tx = engine.begin(0)
    assert run("DELETE FROM notes WHERE fts_match('notes', 'paper')", (), tx) == 1
    run("UPDATE notes SET body = body || ' gold'", (), tx)
    assert bodies("fts_match(notes, 'gold')") == [" gold", "copper wire and wire gold", "tin kettle gold"] and files("paper") == 0
    engine.rollback(tx)
    assert bodies("fts_match(notes, 'gold')") == [] and bodies("fts_match(notes, 'paper')") == ["paper kite"]
    engine.flush()
    engine.optimize(0, "notes")
    engine.flush()
    run("ALTER TABLE notes RENAME COLUMN body TO words")
    run("ALTER TABLE notes RENAME TO memos")
    again = Engine(engine.spark, base_dir=engine.base_dir)
    assert again.query(0, "SELECT words FROM memos WHERE fts_match(memos, 'paper')").rows() == [{"words": "paper kite"}]
    assert not engine._searches and not [x for x in engine.spark.catalog.listTables() if x.name.startswith(f"{engine._views}_search")]


def test_full_text_next_to_outer_joins(run):
    run("CREATE VIRTUAL TABLE notes USING fts5(body, id)")
    run("CREATE TABLE k (id INTEGER PRIMARY KEY)")
    run("INSERT INTO k VALUES (1), (2), (3)")
    run("INSERT INTO notes VALUES ('copper kettle', '1')")
    run("INSERT INTO notes VALUES ('paper kite', '2')")
    for kind in ("LEFT", "FULL", "RIGHT", "INNER"):
        assert run(f"SELECT k.id, body FROM k {kind} JOIN notes n ON k.id = n.id WHERE fts_match(n, 'kite')") == [(2, "paper kite")]
        assert run(f"SELECT k.id, body FROM notes {kind} JOIN k ON k.id = notes.id WHERE fts_match(notes, 'kite')") == [(2, "paper kite")]
    assert run("SELECT k.id FROM k LEFT JOIN notes n ON k.id = n.id AND fts_match(n, 'kite') WHERE n.body IS NULL ORDER BY 1") == [(1,), (3,)]
    assert run("SELECT count(*) FROM notes a JOIN notes b ON a.id < b.id WHERE fts_match(a, 'copper') AND fts_match(b, 'paper')") == [(1,)]
    run("CREATE VIEW kites AS SELECT id FROM notes WHERE fts_match(notes, 'kite')")
    assert run("SELECT id FROM k WHERE id IN (SELECT id FROM kites)") == [(2,)]


def test_full_text_rank(run, engine):
    from math import log

    run("CREATE VIRTUAL TABLE notes USING fts5(body)")
    run("INSERT INTO notes VALUES ('copper kettle boils'), ('copper wire and wire'), ('paper kite'), (NULL)")
    weight = lambda df: log((3 - df + 0.5) / (df + 0.5) + 1)  # noqa: E731  (a null is no text)
    part = lambda n: (n / (8 / 3) + 0.5) / (n / (8 / 3) + 1)
    got = {r["body"]: r["score"] for r in engine.fts_search(0, "notes", "Copper kettle copper absent").collect()}
    assert got == pytest.approx({"copper kettle boils": (2 * weight(2) + weight(1)) * part(3), "copper wire and wire": 2 * weight(2) * part(3)})
    assert engine.fts_search(0, "notes", "absent").collect() == [] and engine.fts_search(0, "notes", "of the").collect() == []
    run("DELETE FROM notes")
    assert engine.fts_search(0, "notes", "copper").columns == ["body", "score"] and engine.fts_search(0, "notes", "copper").collect() == []


def test_compare_and_swap_parameters(run):
    run("CREATE TABLE cas (uuid TEXT PRIMARY KEY, inventory TEXT, updated_at INTEGER)")
    run("INSERT INTO cas VALUES ('u', 'old', 1)")
    assert run("UPDATE cas SET inventory = ?, updated_at = ? WHERE uuid = ? AND updated_at = ?", ["new", 2, "u", 1]) == 1
    assert run("UPDATE cas SET inventory = ?, updated_at = ? WHERE uuid = ? AND updated_at = ?", ["newer", 3, "u", 1]) == 0
    assert run("SELECT * FROM cas") == [("u", "new", 2)]
    run("INSERT INTO cas VALUES (?, ?, ?), (?, ?, ?)", ["a", "x", 5, "b", "it's \\ 100%", None])
    assert run("SELECT inventory, updated_at FROM cas WHERE uuid IN (?, ?) ORDER BY uuid LIMIT ? OFFSET ?", ["a", "b", 5, 1]) == [("it's \\ 100%", None)]
    with pytest.raises(SqlParseError):
        run("SELECT ?")


def test_multi_row_and_set_from_columns(run):
    run("CREATE TABLE t (a INTEGER, b INTEGER)")
    assert run("INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)") == 3
    run("UPDATE t SET a = b + 1, b = a")
    assert run("SELECT a, b FROM t ORDER BY a") == [(11, 1), (21, 2), (31, 3)]
    assert run("INSERT INTO t (a) SELECT b FROM t WHERE b > 1") == 2
    assert run("INSERT INTO t SELECT a, b FROM t WHERE a > 1000") == 0
    assert run("SELECT count(*), count(b), sum(a) FROM t") == [(5, 3, 68)]


def test_rollback_undoes_and_shows_its_own_changes(run, engine):
    run("CREATE TABLE t (a INTEGER, note TEXT)")
    run("INSERT INTO t VALUES (1, 'x'), (2, 'y')")
    tx = engine.begin(0)
    run("INSERT INTO t VALUES (3, 'z')", tx=tx)
    run("UPDATE t SET a = a * 10 WHERE a < 3", tx=tx)
    run("DELETE FROM t WHERE note = 'y'", tx=tx)
    run("INSERT INTO t VALUES (99, 'other')")
    assert run("SELECT a FROM t ORDER BY a") == [(3,), (10,), (99,)]
    engine.rollback(tx)
    assert run("SELECT a, note FROM t ORDER BY a") == [(1, "x"), (2, "y"), (99, "other")]
    with pytest.raises(TransactionError):
        engine.rollback(tx)
    tx = engine.query(0, "BEGIN").tx_id
    run("DELETE FROM t", tx=tx)
    run("COMMIT", tx=tx)
    assert run("SELECT * FROM t") == []
    with pytest.raises(TransactionError):
        run("INSERT INTO t VALUES (1, 'x')", tx=tx)


def test_interleaved_transactions(run, engine):
    run("CREATE TABLE t (a INTEGER PRIMARY KEY, b INTEGER)")
    run("INSERT INTO t VALUES (1, 0), (2, 0)")
    one, two = engine.begin(0), engine.begin(0)
    run("UPDATE t SET b = 1 WHERE a = 1", tx=one)
    run("UPDATE t SET b = 2 WHERE a = 2", tx=two)
    with pytest.raises(ConstraintViolation):
        run("INSERT INTO t VALUES (3, 3), (1, 1)", tx=one)
    run("INSERT INTO t VALUES (4, 4)", tx=one)
    engine.commit(two)
    engine.rollback(one)
    assert run("SELECT * FROM t ORDER BY a") == [(1, 0), (2, 2)]


def test_statements_are_atomic(run):
    run("CREATE TABLE t (a INTEGER UNIQUE)")
    run("INSERT INTO t VALUES (1)")
    with pytest.raises(ConstraintViolation):
        run("INSERT INTO t VALUES (2), (1)")
    assert run("SELECT a FROM t") == [(1,)]
    run("INSERT INTO t VALUES (NULL), (NULL), (5)")
    run("UPDATE t SET a = a + 1")  # collides on the way, not at the end
    with pytest.raises(ConstraintViolation):
        run("UPDATE t SET a = 7")


def test_constraints(run):
    run("CREATE TABLE parent (id INTEGER PRIMARY KEY)")
    run("CREATE TABLE child (id INTEGER PRIMARY KEY, parent_id INTEGER, FOREIGN KEY (parent_id) REFERENCES parent (id))")
    with pytest.raises(ConstraintViolation, match="FOREIGN KEY"):
        run("INSERT INTO child VALUES (1, 1)")
    run("INSERT INTO parent VALUES (1)")
    run("INSERT INTO child VALUES (1, 1), (2, NULL)")
    with pytest.raises(ConstraintViolation, match="FOREIGN KEY"):
        run("UPDATE child SET parent_id = 9 WHERE id = 1")
    run("CREATE TABLE c (age INTEGER CHECK (age >= 0), name TEXT NOT NULL, CHECK (length(name) < 5))")
    run("INSERT INTO c VALUES (5, 'ok'), (NULL, 'ok')")
    for bad in ("(-1, 'x')", "(1, NULL)", "(1, 'toolong')"):
        with pytest.raises(ConstraintViolation):
            run(f"INSERT INTO c VALUES {bad}")
    run("CREATE TABLE k (a INTEGER, b INTEGER, v TEXT, PRIMARY KEY (a, b), UNIQUE (v))")
    run("INSERT INTO k VALUES (1, 1, 'x'), (1, 2, 'y')")
    with pytest.raises(ConstraintViolation):
        run("INSERT INTO k VALUES (1, 1, 'z')")
    with pytest.raises(ConstraintViolation):
        run("INSERT INTO k VALUES (NULL, 3, 'z')")
    with pytest.raises(ConstraintViolation):
        run("INSERT INTO k VALUES (3, 3, 'x')")
    run("CREATE TABLE e (id INTEGER PRIMARY KEY, email TEXT UNIQUE)")
    run("INSERT INTO e VALUES (1, 'a')")
    assert run("UPDATE e SET email = 'a' WHERE id = 1") == 1
    with pytest.raises(EngineError):
        run("INSERT INTO e VALUES ('text', 'b')")


def test_foreign_key_actions(run):
    run("CREATE TABLE p (id INTEGER PRIMARY KEY)")
    run("CREATE TABLE cascading (id INTEGER PRIMARY KEY, p INTEGER REFERENCES p (id) ON DELETE CASCADE ON UPDATE CASCADE)")
    run("CREATE TABLE nulling (p INTEGER REFERENCES p (id) ON DELETE SET NULL)")
    run("CREATE TABLE defaulting (p INTEGER DEFAULT 3, FOREIGN KEY (p) REFERENCES p (id) ON DELETE SET DEFAULT)")
    run("CREATE TABLE deep (c INTEGER REFERENCES cascading ON DELETE CASCADE)")
    run("INSERT INTO p VALUES (1), (2), (3), (4)")
    run("INSERT INTO cascading VALUES (10, 1), (20, 2)")
    run("INSERT INTO nulling VALUES (1), (2)")
    run("INSERT INTO defaulting VALUES (1), (2)")
    run("INSERT INTO deep VALUES (10), (20)")
    assert run("DELETE FROM p WHERE id = 1") == 1
    assert run("SELECT * FROM cascading") == [(20, 2)] and run("SELECT * FROM deep") == [(20,)]
    assert run("SELECT * FROM nulling ORDER BY p") == [(None,), (2,)] and run("SELECT * FROM defaulting ORDER BY p") == [(2,), (3,)]
    run("UPDATE p SET id = 40 WHERE id = 2")
    assert run("SELECT * FROM cascading") == [(20, 40)]
    run("CREATE TABLE holding (p INTEGER REFERENCES p ON DELETE RESTRICT)")
    run("INSERT INTO holding VALUES (4)")
    with pytest.raises(ConstraintViolation):
        run("DELETE FROM p")
    assert run("SELECT count(*) FROM p") == [(3,)]


def test_defaults_and_rowids(run):
    run("CREATE TABLE t (id INTEGER PRIMARY KEY, status TEXT DEFAULT 'new', n INTEGER DEFAULT -5, b BLOB DEFAULT X'0aff')")
    run("INSERT INTO t (status) VALUES ('x')")
    run("INSERT INTO t (id, status) VALUES (10, NULL)")
    run("INSERT INTO t DEFAULT VALUES")
    run("INSERT INTO t (n) SELECT n + 1 FROM t WHERE id < 11")
    assert run("SELECT id, status, n, hex(b) FROM t ORDER BY id") == [(1, "x", -5, "0aff"), (10, None, -5, "0aff"), (11, "new", -5, "0aff"), (12, "new", -4, "0aff"), (13, "new", -4, "0aff")]


def test_joins(run):
    run("CREATE TABLE authors (id INTEGER, name TEXT)")
    run("CREATE TABLE books (id INTEGER, title TEXT, author_id INTEGER)")
    run("INSERT INTO authors VALUES (1, 'Ann'), (2, 'Ben'), (3, 'Cy')")
    run("INSERT INTO books VALUES (1, 'A', 1), (2, 'B', 1), (3, 'C', 9)")
    assert run("SELECT b.title, a.name FROM books b LEFT JOIN authors a ON b.author_id = a.id ORDER BY b.id") == [("A", "Ann"), ("B", "Ann"), ("C", None)]
    assert run("SELECT a.id AS x, b.id AS y FROM books b RIGHT JOIN authors a ON b.author_id = a.id ORDER BY x, y") == [(1, 1), (1, 2), (2, None), (3, None)]
    assert run("SELECT count(*) FROM books b FULL OUTER JOIN authors a ON b.author_id = a.id") == [(5,)]
    assert run("SELECT count(*) FROM books CROSS JOIN authors") == [(9,)]
    assert run("SELECT count(*) FROM books b, authors a WHERE a.id = b.id") == [(3,)]
    assert run("SELECT title, name FROM books JOIN authors USING (id) ORDER BY title") == [("A", "Ann"), ("B", "Ben"), ("C", "Cy")]
    assert run("SELECT title, name FROM books NATURAL JOIN authors ORDER BY title") == [("A", "Ann"), ("B", "Ben"), ("C", "Cy")]
    assert run("SELECT a.* FROM books b JOIN authors a ON a.id < b.id AND a.name <> 'Ben' ORDER BY a.id, b.id") == [(1, "Ann"), (1, "Ann")]
    assert run("SELECT x.name AS a, y.name AS b FROM authors x JOIN authors y ON x.id + 1 = y.id ORDER BY x.id") == [("Ann", "Ben"), ("Ben", "Cy")]
    assert run("SELECT a.name FROM authors a LEFT ANTI JOIN books b ON a.id = b.author_id ORDER BY 1") == [("Ben",), ("Cy",)]


def test_duplicate_output_names_keep_both_values(engine, run):
    run("CREATE TABLE a (id INTEGER)")
    run("INSERT INTO a VALUES (1), (2)")
    out = engine.query(0, "SELECT x.id, y.id FROM a x JOIN a y ON x.id < y.id")
    assert [tuple(r) for r in out.df.collect()] == [(1, 2)]
    assert out.to_json()["rows"] == [{"id": 1}] and out.to_json()["columns"] == ["id"]


def test_grouping(run):
    run("CREATE TABLE s (k TEXT, v INTEGER, r REAL)")
    run("INSERT INTO s VALUES ('a', 1, 1.5), ('a', 2, NULL), ('b', NULL, 2.0), (NULL, 4, 1.0), (NULL, 4, 1.0)")
    assert run("SELECT k, COUNT(*), COUNT(v), SUM(v), AVG(v), MIN(v), MAX(r) FROM s GROUP BY k ORDER BY k") == [(None, 2, 2, 8, 4.0, 4, 1.0), ("a", 2, 2, 3, 1.5, 1, 1.5), ("b", 1, 0, None, None, None, 2.0)]
    assert run("SELECT COUNT(DISTINCT v), SUM(v * 2), COUNT(*) FROM s") == [(3, 22, 5)]
    assert run("SELECT k, SUM(v) + 1 AS x FROM s GROUP BY k HAVING COUNT(*) > 1 ORDER BY x DESC") == [(None, 9), ("a", 4)]
    assert run("SELECT upper(s.k) AS u, k, r FROM s WHERE k = 'b' GROUP BY s.k") == [("B", "b", 2.0)]
    assert run("SELECT v % 2 AS odd, count(*) FROM s WHERE v IS NOT NULL GROUP BY odd ORDER BY 1") == [(0, 3), (1, 1)]
    assert run("SELECT k, count(*) FROM s GROUP BY ALL ORDER BY COUNT(*) DESC, k LIMIT 1") == [(None, 2)]
    assert run("SELECT DISTINCT k FROM s ORDER BY k LIMIT 2 OFFSET 1") == [("a",), ("b",)]
    assert run("SELECT count(*) FROM s WHERE v > 100") == [(0,)] and run("SELECT sum(v) FROM s WHERE v > 100") == [(None,)]


def test_expressions(run):
    row = run("SELECT 2 + 3, 1 / 2, 4 / 2, 7 % 3, -7 % 3, 1 / 0, 5 % 0, 2 * 1.5, 'a' || NULL || 2.0 || 1, 'x' + 1")[0]
    assert row == (5, 0.5, 2.0, 1, -1, None, None, 3.0, "a21", None)
    assert run("SELECT 'abc' LIKE 'a%', 'abc' LIKE 'A_c', 'aBc' ILIKE 'AB_', 'a\\b' LIKE 'a\\b', 'abc' NOT LIKE '%z%'") == [(1, 0, 1, 1, 1)]
    assert run("SELECT CASE WHEN 1 > 2 THEN 'x' ELSE 'y' END AS a, CASE 3 WHEN 3 THEN 'three' END AS b, CASE WHEN 'text' THEN 1 END AS c") == [("y", "three", 1)]
    assert run("SELECT substr('abcdef', 2, 3) AS a, substr('abc', -5, 3) AS b, substr('abc', 0) AS c, substr('abc', -2) AS d, substr('abc', 2, -1) AS e, substring('abc', 2) AS f") == [("bcd", "abc", "", "bc", "", "bc")]
    assert run("SELECT length('äb'), length(X'0102'), length(12), len(NULL)") == [(2, 2, None, None)]
    assert run("SELECT trim('\t　 x \n') AS a, ltrim('  x ') AS b, rtrim(' x  ') AS c, replace('aXbX', 'X', '-') AS d") == [("x", "x ", " x", "a-b-")]
    assert run("SELECT typeof(1), typeof(1.5), typeof('a'), typeof(NULL), typeof(X'01'), hex('az'), hex(X'AB'), hex(3)") == [("integer", "real", "text", "null", "blob", "617a", "ab", None)]
    assert run("SELECT round(2.5) AS a, round(-2.5) AS b, round(1.005, 2) AS c, round(1234.5, -2) AS d, abs(-3) AS e, abs('x') AS f, coalesce(NULL, 2) AS g, ifnull(NULL, 1) AS h, nullif(1, 1) AS i") == [(3.0, -3.0, 1.0, 1200.0, 3, None, 2, 1, None)]
    assert run("SELECT 1 WHERE 2 BETWEEN 1 AND 3 AND 4 NOT BETWEEN 1 AND 3 AND 1 IN (1, 2) AND 3 NOT IN (1, 2) AND NOT (1 = 2) AND NULL IS NULL AND 1") == [(1,)]
    assert run("SELECT 9007199254740993 AS a, 1e3 AS b, .5 AS c, TRUE AS d, 99999999999999999999 AS e") == [(9007199254740993, 1000.0, 0.5, 1, 1e20)]


def test_column_names(engine, run):
    run("CREATE TABLE t (id INTEGER, name TEXT)")
    run("INSERT INTO t VALUES (1, 'n')")
    assert engine.query(0, "SELECT * FROM t").columns == ["id", "name"]
    assert engine.query(0, "SELECT t.id, name AS who, id  +  1, upper(name) FROM t").columns == ["id", "who", "id + 1", "upper(name)"]
    assert engine.query(0, "SELECT *, id + 1 nxt FROM t").columns == ["id", "name", "nxt"]


def test_alter(run):
    run("CREATE TABLE t (a INTEGER, b TEXT CHECK (b <> 'b'))")
    run("INSERT INTO t VALUES (1, 'x')")
    run("ALTER TABLE t ADD COLUMN c INTEGER DEFAULT 7, ADD COLUMN d TEXT")
    run("INSERT INTO t (a) VALUES (2)")
    assert run("SELECT * FROM t ORDER BY a") == [(1, "x", 7, None), (2, None, 7, None)]
    run("ALTER TABLE t RENAME COLUMN b TO bee")
    assert run("SELECT bee FROM t WHERE a = 1") == [("x",)]
    with pytest.raises(ConstraintViolation):
        run("INSERT INTO t (a, bee) VALUES (3, 'b')")
    run("ALTER TABLE t DROP COLUMN c")
    run("ALTER TABLE t ADD COLUMN c TEXT")
    assert run("SELECT c FROM t WHERE a = 1") == [(None,)]
    run("ALTER TABLE t RENAME TO u")
    assert run("SELECT count(*) FROM u") == [(2,)]
    with pytest.raises(SchemaError):
        run("SELECT * FROM t")
    run("ALTER TABLE u DROP COLUMN IF EXISTS nothing")
    with pytest.raises(SchemaError):
        run("ALTER TABLE u DROP COLUMN nothing")
    run("DROP TABLE u")
    run("DROP TABLE IF EXISTS u")
    with pytest.raises(SchemaError):
        run("DROP TABLE u")


def test_indexes(run, engine):
    run("CREATE TABLE t (id INTEGER, score INTEGER)")
    run("INSERT INTO t VALUES (1, 10), (2, 20), (3, 30), (4, 40)")
    run("CREATE INDEX by_score ON t (score)")
    assert run("SELECT id FROM t WHERE score > 20 ORDER BY id") == [(3,), (4,)]
    assert run("SELECT id FROM t WHERE score BETWEEN ? AND ? ORDER BY id", [15, 30]) == [(2,), (3,)]
    plan = engine.query(0, "SELECT id FROM t WHERE score = 20").df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c2), EqualTo(c2,20)]" in plan
    run("CREATE INDEX IF NOT EXISTS by_score ON t (score)")
    run("CREATE UNIQUE INDEX one ON t (id)")
    with pytest.raises(ConstraintViolation):
        run("INSERT INTO t VALUES (1, 50)")
    run("DROP INDEX one")
    run("INSERT INTO t VALUES (1, 50)")
    with pytest.raises(SchemaError):
        run("CREATE UNIQUE INDEX one ON t (id)")
    with pytest.raises(SchemaError):
        run("DROP INDEX one")


def test_trigger_kinds(run):
    run("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, name2 TEXT)")
    run("CREATE TABLE log (id INTEGER PRIMARY KEY, what TEXT)")
    for timing in ("BEFORE", "AFTER"):
        run(f"CREATE TRIGGER {timing}i {timing} INSERT ON t BEGIN INSERT INTO log (what) VALUES ('{timing} i ' || NEW.name2); END")
        run(f"CREATE TRIGGER {timing}d {timing} DELETE ON t BEGIN INSERT INTO log (what) VALUES ('{timing} d ' || OLD.name || 'OLD.name'); END")
    run("CREATE TRIGGER u AFTER UPDATE ON t WHEN NEW.name <> OLD.name BEGIN INSERT INTO log (what) VALUES ('u1'); INSERT INTO log (what) VALUES ('u2 ' || NEW.id); END")
    run("INSERT INTO t VALUES (1, 'n', 'm')")
    run("UPDATE t SET name2 = 'q'")
    run("UPDATE t SET name = 'o'")
    run("DELETE FROM t")
    assert [w for (w,) in run("SELECT what FROM log ORDER BY id")] == ["BEFORE i m", "AFTER i m", "u1", "u2 1", "BEFORE d oOLD.name", "AFTER d oOLD.name"]
    run("DROP TRIGGER u")
    with pytest.raises(SchemaError):
        run("DROP TRIGGER u")
    with pytest.raises(TriggerError):
        run("CREATE TRIGGER bad AFTER INSERT ON t BEGIN INSERT INTO log (what) VALUES (OLD.name); END")
        run("INSERT INTO t VALUES (5, 'a', 'b')")


def test_triggers_that_change_rows(run):
    run("CREATE TABLE items (id INTEGER PRIMARY KEY, box INTEGER, w INTEGER)")
    run("CREATE TABLE boxes (id INTEGER PRIMARY KEY, total INTEGER)")
    run("INSERT INTO boxes VALUES (1, 0), (2, 0)")
    run("CREATE TRIGGER i AFTER INSERT ON items BEGIN UPDATE boxes SET total = total + NEW.w WHERE id = NEW.box; END")
    run("INSERT INTO items VALUES (1, 1, 5), (2, 1, 6), (3, 2, 7)")  # two rows meet one box: one at a time
    assert run("SELECT * FROM boxes ORDER BY id") == [(1, 11), (2, 7)]
    run("CREATE TRIGGER d AFTER DELETE ON boxes BEGIN DELETE FROM items WHERE box = OLD.id; END")
    run("DELETE FROM boxes")
    assert run("SELECT * FROM items") == []


def test_trigger_failure_undoes_the_statement(run):
    run("CREATE TABLE t (a INTEGER)")
    run("CREATE TABLE u (a INTEGER CHECK (a < 5))")
    run("CREATE TRIGGER x AFTER INSERT ON t BEGIN INSERT INTO u VALUES (NEW.a); END")
    with pytest.raises(ConstraintViolation):
        run("INSERT INTO t VALUES (1), (9)")
    assert run("SELECT count(*) FROM t") == [(0,)] and run("SELECT count(*) FROM u") == [(0,)]
    run("CREATE TRIGGER loop AFTER INSERT ON u BEGIN INSERT INTO u VALUES (NEW.a); END")
    from quillspark.operators import dml

    dml.DEPTH, was = 3, dml.DEPTH
    try:
        with pytest.raises(TriggerError):
            run("INSERT INTO u VALUES (1)")
    finally:
        dml.DEPTH = was


def test_instead_of_triggers(run):
    run("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    run("CREATE VIEW v AS SELECT id, upper(name) AS shown FROM t")
    run("CREATE TRIGGER vi INSTEAD OF INSERT ON v BEGIN INSERT INTO t VALUES (NEW.id, lower(NEW.shown)); END")
    run("CREATE TRIGGER vu INSTEAD OF UPDATE ON v BEGIN UPDATE t SET name = lower(NEW.shown) WHERE id = OLD.id; END")
    run("CREATE TRIGGER vd INSTEAD OF DELETE ON v BEGIN DELETE FROM t WHERE id = OLD.id; END")
    assert run("INSERT INTO v VALUES (1, 'ABC'), (2, 'DEF')") == 2
    run("UPDATE v SET shown = shown || 'X' WHERE id = 1")
    run("DELETE FROM v WHERE shown = 'DEF'")
    assert run("SELECT * FROM t") == [(1, "abcx")]


def test_restart(spark, engine, run):
    run("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    run("INSERT INTO t (name) VALUES ('a')")
    run("CREATE VIEW v AS SELECT name FROM t")
    engine.put(0, "raw", b"k1", b"v1")
    engine.flush()
    again = Engine(spark, base_dir=engine.base_dir)
    again.query(0, "INSERT INTO t (name) VALUES ('b')")
    assert again.query(0, "SELECT * FROM t ORDER BY id").rows() == [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]
    assert again.query(0, "SELECT * FROM v ORDER BY name").rows() == [{"name": "a"}, {"name": "b"}]
    assert again.get(0, "raw", b"k1") == b"v1"
    engine.files.write(f"{engine.base_dir}/db_0/catalog.json", "not json")
    assert Engine(spark, base_dir=engine.base_dir).databases[0].tables == {}
    assert engine.files.exists(f"{engine.base_dir}/db_0/catalog.json.bak")


def test_flush_keeps_what_is_read(run, engine):
    run("CREATE TABLE t (a INTEGER)")
    for i in range(3):
        run("INSERT INTO t VALUES (?)", [i])
    run("UPDATE t SET a = a + 1")
    engine.flush()
    assert run("SELECT a FROM t ORDER BY a") == [(1,), (2,), (3,)]


def test_optimize_gathers_small_files(run, engine):
    run("CREATE TABLE t (a INTEGER, b TEXT)")
    for i in range(5):
        run("INSERT INTO t VALUES (?, 'x')", [i])
    assert len(engine.database(0).table("t").files) == 5
    tx = engine.begin(0)
    run("DELETE FROM t WHERE a = 0", tx=tx)
    engine.optimize(0, "t")
    assert len(engine.database(0).table("t").files) == 1
    engine.rollback(tx)
    engine.flush()
    assert run("SELECT a FROM t ORDER BY a") == [(i,) for i in range(5)]
    run("CREATE INDEX i ON t (a)")
    engine.optimize(0, "t")
    engine.flush()
    assert run("SELECT b FROM t WHERE a = 3") == [("x",)]


def test_only_touched_files_are_rewritten(run, engine):
    run("CREATE TABLE t (a INTEGER)")
    run("INSERT INTO t VALUES (1), (2)")
    run("INSERT INTO t VALUES (3)")
    before = set(engine.database(0).table("t").files)
    run("DELETE FROM t WHERE a = 3")
    assert len(before & set(engine.database(0).table("t").files)) == 1


def test_beyond_the_dialect(run):
    run("CREATE TABLE t (a INTEGER, b TEXT)")
    run("INSERT INTO t VALUES (1, 'x'), (2, 'y'), (2, 'z')")
    assert run("SELECT a FROM t UNION SELECT 5 ORDER BY a") == [(1,), (2,), (5,)]
    assert run("WITH c AS (SELECT a, count(*) AS n FROM t GROUP BY a) SELECT * FROM c WHERE n > 1") == [(2, 2)]
    assert run("SELECT b, row_number() OVER (PARTITION BY a ORDER BY b DESC) AS r FROM t ORDER BY b") == [("x", 1), ("y", 2), ("z", 1)]
    assert run("SELECT b FROM t WHERE a IN (SELECT max(a) FROM t) AND EXISTS (SELECT 1 FROM t) ORDER BY b") == [("y",), ("z",)]
    assert run("SELECT a, count(*) FROM t GROUP BY ROLLUP (a) ORDER BY a") == [(None, 3), (1, 1), (2, 2)]
    assert run("SELECT sum(a) AS s FROM (SELECT DISTINCT a FROM t) d") == [(3,)]
    assert run("SELECT CAST('7' AS INTEGER) + 1 AS a, CAST('x' AS REAL) AS b") == [(8, None)]
    with pytest.raises(UnsupportedError):
        run("MERGE INTO t USING t ON 1 = 1")
    with pytest.raises(UnsupportedError):
        run("DELETE FROM t; DELETE FROM t")
    with pytest.raises(SqlParseError):
        run("SELECT 1; SELECT 2")
    with pytest.raises(EngineError):
        run("SELECT no_such_function(1)")
    with pytest.raises(SchemaError):
        run("SELECT nope FROM t")


def test_result_as_json(run, engine):
    run("CREATE TABLE t (a INTEGER, r REAL, b BLOB)")
    run("INSERT INTO t VALUES (?, ?, ?)", [True, float("nan"), {"__blob__": "AP8="}])
    out = engine.query(0, "SELECT a, r, b FROM t").to_json()
    assert out["rows"] == [{"a": 1, "r": None, "b": "AP8="}] and out["columns"] == ["a", "r", "b"]
    assert set(out["timing"]) == {"params_us", "engine_us", "encode_us", "total_us"} and out["affected_rows"] is None
    assert engine.query(0, "DELETE FROM t").to_json()["affected_rows"] == 1
    assert engine.db_id("default") == 0 and engine.db_id("nope") is None


def test_files_in_and_out(engine, run, tmp_path):
    run("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, n INTEGER DEFAULT 4)")
    run("INSERT INTO t (name) VALUES ('a'), ('b')")
    for form, options in (("csv", {"header": True}), ("json", {}), ("orc", {}), ("parquet", {})):
        engine.export(0, "SELECT name FROM t WHERE id <= ?", f"file://{tmp_path}/{form}", form, [2], **options)
        assert engine.load(0, "t", f"file://{tmp_path}/{form}", form, **options) == 2
    assert run("SELECT name, COUNT(*), COUNT(DISTINCT id), MIN(n) FROM t GROUP BY name ORDER BY name") == [("a", 5, 5, 4), ("b", 5, 5, 4)]


def test_null_matrix(run, compat):
    """Every comparison of {NULL, 0, 1} with itself: three-valued by default, null lowest and equal to itself in compat mode."""
    order = {None: -1, 0: 0, 1: 1}
    for a in order:
        for b in order:
            for op, test in (("=", lambda x, y: x == y), ("<>", lambda x, y: x != y), ("<", lambda x, y: x < y), ("<=", lambda x, y: x <= y), (">", lambda x, y: x > y), (">=", lambda x, y: x >= y)):
                want = None if a is None or b is None else int(test(a, b))
                assert run(f"SELECT ? {op} ? AS r", [a, b]) == [(want,)]
    pairs = [(a, b) for a in order for b in order]
    text = ", ".join(f"({'NULL' if a is None else a}, {'NULL' if b is None else b})" for a, b in pairs)
    compat.query(0, "CREATE TABLE p (a INTEGER, b INTEGER)")
    compat.query(0, f"INSERT INTO p VALUES {text}")
    rows = compat.query(0, "SELECT a, b, a = b AS eq, a <> b AS ne, a < b AS lt, a <= b AS le, a > b AS gt, a >= b AS ge, NOT a AND b AS nab, a IN (b, 7) AS isin, CASE a WHEN b THEN 1 ELSE 0 END AS c FROM p").rows()
    assert len(rows) == 9
    for r in rows:
        x, y = order[r["a"]], order[r["b"]]
        assert (r["eq"], r["ne"], r["lt"], r["le"], r["gt"], r["ge"]) == tuple(map(int, (x == y, x != y, x < y, x <= y, x > y, x >= y)))
        assert r["nab"] == int(not r["a"] and bool(r["b"])) and r["isin"] == r["c"] == int(x == y)


def test_random_changes_against_a_dictionary(engine, run):
    """Seeded statements, some in transactions that are rolled back, leave what the same leave in a dictionary."""
    import random

    rng = random.Random(11)
    run("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER)")
    model: dict[int, int] = {}
    for step in range(14):
        tx = engine.begin(0) if step % 5 == 4 else None
        before = dict(model)
        for _ in range(2):
            kind, k = rng.choice(["insert", "insert", "update", "delete"]), rng.randint(1, 6)
            if kind == "insert":
                rows = {rng.randint(1, 60): rng.randint(0, 9) for _ in range(3)}
                try:
                    run("INSERT INTO t VALUES " + ", ".join(f"({i}, {v})" for i, v in rows.items()), tx=tx)
                    assert not rows.keys() & model.keys()
                    model |= rows
                except ConstraintViolation:
                    assert rows.keys() & model.keys()
            elif kind == "update":
                assert run("UPDATE t SET v = v + 10 WHERE id % 6 + 1 = ?", [k], tx=tx) == sum(i % 6 + 1 == k for i in model)
                model = {i: v + 10 * (i % 6 + 1 == k) for i, v in model.items()}
            else:
                assert run("DELETE FROM t WHERE v % 7 + 1 = ?", [k], tx=tx) == sum(v % 7 + 1 == k for v in model.values())
                model = {i: v for i, v in model.items() if v % 7 + 1 != k}
        if tx is not None:
            engine.rollback(tx)
            model = before
        assert dict(run("SELECT id, v FROM t")) == model


def test_trigger_statements_go_row_by_row(run):
    run("CREATE TABLE t (id INTEGER PRIMARY KEY, prev INTEGER)")
    run("CREATE TABLE log (id INTEGER)")
    run("CREATE TRIGGER a AFTER INSERT ON t BEGIN INSERT INTO log VALUES (NEW.id); DELETE FROM log WHERE id = NEW.prev; END")
    run("INSERT INTO t VALUES (1, 2), (2, 1)")
    assert run("SELECT id FROM log") == [(2,)]
    run("CREATE TABLE seen (id INTEGER PRIMARY KEY, what TEXT)")
    run("CREATE TRIGGER b AFTER DELETE ON t WHEN OLD.id > 1 BEGIN INSERT INTO seen (what) VALUES ('b' || OLD.id); END")
    run("CREATE TRIGGER c AFTER DELETE ON t BEGIN INSERT INTO seen (what) VALUES ('c' || OLD.id); END")
    run("DELETE FROM t")
    assert [w for (w,) in run("SELECT what FROM seen ORDER BY id")] == ["c1", "b2", "c2"]


def test_independent_trigger_statements_run_at_once(run, engine, monkeypatch):
    run("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    run("CREATE TABLE a (id INTEGER)")
    run("CREATE TABLE b (id INTEGER)")
    run("CREATE TRIGGER x AFTER INSERT ON t BEGIN INSERT INTO a VALUES (NEW.id); INSERT INTO b VALUES (NEW.id * 2); END")
    monkeypatch.setattr(type(engine.changes), "_row_by_row", lambda *a: pytest.fail("row by row"))
    run("INSERT INTO t VALUES (1), (2), (3)")
    assert run("SELECT count(*) FROM a JOIN b ON a.id * 2 = b.id") == [(3,)]
