"""A store of people in a folder of Parquet tables, and the plans that change and read it.

A table is a list of Parquet folders. A change writes new folders beside the old ones - an append only what it adds - and then publishes one
manifest (`_manifest/m<number>`) that names the folders of all tables. Readers take the last manifest, so a change is seen as a whole or not at all, and
a job that dies anywhere leaves the store as it was. There is one writer at a time. A batch of files is imported at once: cards of one person are found by links and
components, not one after the other, so that the result doesn't depend on the order of files.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masking import mask_email, mask_phone
from ..functions.text import blank_to_null, strip
from ..operators import intervals, matching, merging, screening, search
from ..operators.extract import extract_cards
from ..operators.graph import components
from ..operators.numbering import numbered
from ..sources.files import read_resumes, resume_files
from .. import storage
from ..storage import stored
from ..types import FIELD, SCALAR_FIELDS

TABLES = {
    "candidates": "candidate_id BIGINT, " + ", ".join(f"{f} STRING" for f in SCALAR_FIELDS) + ", latest_resume_id BIGINT, years DOUBLE, latest INT, n_jobs INT, parsed_at STRING",
    "resumes": "resume_id BIGINT, candidate_id BIGINT, source_file STRING, file_type STRING, file_sha256 STRING, resume_date STRING, card_json STRING",
    "experiences": "resume_id BIGINT, candidate_id BIGINT, company STRING, title STRING, start STRING, end STRING",
    "tags": "candidate_id BIGINT, kind STRING, tag STRING",
    "conflicts": "conflict_id STRING, candidate_id BIGINT, field STRING, option_a STRING, option_b STRING, chosen STRING, status STRING",
    "originals": "file_sha256 STRING, source_file STRING, content BINARY",
    "settings": "k STRING, v STRING",
    "documents": "candidate_id BIGINT, version BIGINT, " + ", ".join(f"{c} STRING" for c in search.COLUMNS),
    "postings": "gram STRING, col STRING, candidate_id BIGINT, version BIGINT, bucket INT",
}
PEOPLE = ("candidates", "resumes", "experiences", "tags", "conflicts", "originals", "documents", "postings")
#: Columns that make folders.
FOLDERS = {"postings": ["bucket"]}
#: Folders that a table is made of before an append writes it anew as one.
MOST_PARTS = 64
PENDING_MERGE = "candidate_merge"


class PeopleStore:
    def __init__(self, spark: SparkSession, root: str, readings: DataFrame | None = None):
        """readings (char, reading, place): how characters of names are read, for names that sound alike; without it names match by equality."""
        self.spark, self.root, self.readings = spark, root.rstrip("/"), readings
        self._results: list[str] = []

    # --- tables ---

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        where, fs = self._folder(f"{self.root}/_manifest")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:]) for n in names if n[:1] == "m" and n[1:].isdigit())

    def _read(self, number: int) -> dict[str, list[str]]:
        """The folders of each table by a manifest."""
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/_manifest/m{number}", wholetext=True).collect()))

    def _now(self) -> dict[str, list[str]]:
        known = self._manifests()
        return self._read(known[-1]) if known else {}

    def table(self, name: str) -> DataFrame:
        parts = self._now().get(name, [])
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        read, paths = self.spark.read.schema(TABLES[name]).parquet, [f"{self.root}/{name}/{p}" for p in parts]
        return functools.reduce(DataFrame.unionByName, map(read, paths)) if name in FOLDERS else read(*paths)

    def commit(self, replaced: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None, emptied: tuple[str, ...] = ()) -> None:
        """Replaces tables, adds rows to tables and empties tables, all at once."""
        now = self._now()
        parts = {name: list(now.get(name, [])) for name in TABLES}
        for name in emptied:
            parts[name] = []
        for name, rows in (replaced or {}).items():
            parts[name] = [self._written(name, rows)]
        for name, rows in (added or {}).items():
            if len(parts[name]) >= MOST_PARTS:
                parts[name] = [self._written(name, self._live(name, self.table(name).unionByName(rows.select(*self.table(name).columns)), added))]
            else:
                parts[name].append(self._written(name, rows))
        self._publish(parts)
        self._sweep()

    def _written(self, name: str, rows: DataFrame) -> str:
        part = f"p{uuid.uuid4().hex}"
        rows.select(*(x.split()[0] for x in TABLES[name].split(", "))).write.partitionBy(*FOLDERS.get(name, [])).parquet(f"{self.root}/{name}/{part}")
        return part

    def _live(self, name: str, rows: DataFrame, added: dict[str, DataFrame]) -> DataFrame:
        """rows of a table that is written anew; of the search index, only what the last version of each person has."""
        if name not in ("documents", "postings"):
            return rows
        last = search.latest(self.table("documents").unionByName(added["documents"]), "candidate_id").where(F.coalesce(*(F.col("text")[c] for c in search.COLUMNS)).isNotNull())
        return rows.join(last.select("candidate_id", "version"), ["candidate_id", "version"], "left_semi")

    def _publish(self, parts: dict[str, list[str]]) -> None:
        """The one step that makes a change visible: a finished file gets its name."""
        known = self._manifests()
        number = (known[-1] if known else 0) + 1
        held, fs = self._folder(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        out = fs.create(held, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if not fs.rename(held, self._folder(f"{self.root}/_manifest/m{number}")[0]):
            raise OSError("the manifest can't be published")

    def _sweep(self) -> None:
        """Removes what neither the last manifest nor the one before it (readers under way) names, what failed writes left included."""
        known = self._manifests()
        named = [self._read(n) for n in known[-2:]]
        for name in TABLES:
            where, fs = self._folder(f"{self.root}/{name}")
            if fs.exists(where):
                for s in fs.listStatus(where):
                    if not any(s.getPath().getName() in m.get(name, []) for m in named):
                        fs.delete(s.getPath(), True)
        for n in known[:-2]:
            where, fs = self._folder(f"{self.root}/_manifest/m{n}")
            fs.delete(where, False)

    def replace(self, name: str, rows: DataFrame) -> None:
        self.commit({name: rows})

    def append(self, name: str, rows: DataFrame) -> None:
        self.commit(added={name: rows})

    # --- import ---

    def import_files(self, path: str, parsed_at: str, glyphs: DataFrame | None = None) -> DataFrame:
        """Imports the files under path: source_file, status (new, merged, manual_review, duplicate, failed), candidate_id, error."""
        found = resume_files(self.spark, path)
        with storage.scope() as paths:
            files = stored(read_resumes(found, glyphs).withColumn("parsed_at", F.lit(parsed_at)), "files")
            out = self.import_parsed(files, found.select("source_file", "content"))
            self._let_go(paths)
        return out

    def _let_go(self, paths: list[str]) -> None:
        """Deletes the scratch tables of a change that is done; the last table, what an import reports, stays until the people are purged."""
        storage.release(self.spark, [p for p in paths if p not in self._results])

    def import_parsed(self, files: DataFrame, contents: DataFrame | None = None) -> DataFrame:
        """The same for files as read_resumes() gives them, with parsed_at. Of contents (source_file, content), the store keeps those of the files it takes."""
        with storage.scope() as paths:
            out = stored(self._imported(files, contents), "imported")
            self._results.append(paths[-1])
            self._let_go(paths)
        return out

    def _imported(self, files: DataFrame, contents: DataFrame | None) -> DataFrame:
        good = files.where("error is null")
        marked = merging.first_by_hash(good.select("source_file", "file_sha256"), "file_sha256", ["source_file"], self.table("resumes"))
        marked = stored(marked, "marked")
        fresh = good.join(marked.where("status = 'new'").select("source_file"), "source_file", "left_semi")
        cards = stored(extract_cards(fresh), "cards")
        placed = stored(self._place(cards), "placed")
        self._write(placed, contents)
        done = placed.select("source_file", "status", "candidate_id")
        known = self.table("resumes").select("file_sha256", "candidate_id").dropDuplicates(["file_sha256"])
        again = marked.where("status = 'duplicate'").join(known, "file_sha256", "left").select("source_file", "status", "candidate_id")
        failed = files.where("error is not null").select("source_file", F.lit("failed").alias("status"), F.lit(None).cast("bigint").alias("candidate_id"), "error")
        return done.unionByName(again).withColumn("error", F.lit(None).cast("string")).unionByName(failed)

    def _profiles(self, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Profiles and employments of cards (pid negative) and of people in the store."""
        names = {"name": "name", "phone": "phone", "email": "email", "school": "school", "major": "major", "desired_position": "desired"}
        new = cards.select("pid", *(F.col("fields")[f]["value"].alias(a) for f, a in names.items()))
        old = self.table("candidates").select(F.col("candidate_id").alias("pid"), *(F.col(f).alias(a) for f, a in names.items()))
        jobs = cards.select("pid", F.explode("experiences").alias("e")).select("pid", "e.company", "e.start", "e.end")
        jobs = jobs.unionByName(self.table("experiences").select(F.col("candidate_id").alias("pid"), "company", "start", "end"))
        months = intervals.month_intervals(jobs, ["pid", "company"])
        lost = jobs.join(months.select("pid", "company").distinct(), ["pid", "company"], "left_anti").select("pid", "company", F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"))
        people = new.unionByName(old)
        if self.readings is not None:
            people = matching.with_name_keys(people, self.readings)
        return people, months.unionByName(lost)

    def _place(self, cards: DataFrame) -> DataFrame:
        """cards with resume_id, candidate_id, status, and the person that a manual review would merge with (review_id)."""
        last = self.table("resumes").agg(F.max("resume_id")).first()[0] or 0
        cards = stored(numbered(cards, ["source_file"], "resume_id", last).withColumn("pid", -F.col("resume_id")), "numbered-cards")
        people, jobs = self._profiles(cards)
        pairs = matching.candidate_pairs(people, jobs).where("a < 0")  # at least one is new
        rows = stored(matching.decided(matching.pair_scores(pairs, people, jobs.where("s is not null"))).where("decision != 'different_person'").select("a", "b", "score", "decision"), "decisions")
        auto = rows.where("decision = 'auto_merge'")
        group = components(auto.where("b < 0").select(F.col("a").alias("a"), F.col("b").alias("b")))
        cards = cards.join(group, F.col("pid") == F.col("id"), "left").withColumn("grp", F.coalesce("component", "pid")).drop("id", "component")
        best = F.max(F.struct("score", (-F.col("b")).alias("nb")))
        to = lambda tier: (rows.where(f"b > 0 and decision = '{tier}'").join(cards.select("pid", "grp"), F.col("a") == F.col("pid")).groupBy("grp").agg((-best["nb"]).alias(tier)))
        groups = cards.groupBy("grp").agg(F.min("source_file").alias("first_file")).join(to("auto_merge"), "grp", "left").join(to("manual_review"), "grp", "left")
        high = self.table("candidates").agg(F.max("candidate_id")).first()[0] or 0
        new = numbered(groups.where("auto_merge is null"), ["first_file"], "candidate_id", high)
        old = groups.where("auto_merge is not null").withColumn("candidate_id", F.col("auto_merge"))
        among = rows.where("decision = 'manual_review' and b < 0").join(cards.select(F.col("pid").alias("b2"), F.col("grp").alias("g2")), F.expr("b = b2")).join(cards.select(F.col("pid").alias("a2"), F.col("grp")), F.expr("a = a2")).where("grp != g2")
        placed = stored(old.unionByName(new), "placed-groups")
        other = placed.select(F.col("grp").alias("g2"), F.col("candidate_id").alias("other"))
        mine = placed.select("grp", F.col("candidate_id").alias("own"))
        sibling = among.join(other, "g2").join(mine, "grp")
        sibling = sibling.select(F.greatest("own", "other").alias("hi"), F.least("own", "other").alias("lo")).where("hi != lo").groupBy("hi").agg(F.min("lo").alias("sibling"))
        placed = placed.join(sibling, F.col("candidate_id") == F.col("hi"), "left")
        placed = placed.withColumn("review_id", F.when(F.col("auto_merge").isNull(), F.coalesce("manual_review", "sibling")))
        out = cards.join(placed.select("grp", "candidate_id", "auto_merge", "review_id", "first_file"), "grp")
        status = (F.when(F.col("auto_merge").isNotNull() | (F.col("source_file") != F.col("first_file")), "merged")
                  .when(F.col("review_id").isNotNull(), "manual_review").otherwise("new"))
        return out.withColumn("status", status)

    def _write(self, placed: DataFrame, contents: DataFrame | None = None) -> None:
        cards = placed.drop("pid", "grp", "auto_merge", "first_file", "review_id", "status", "resume_id", "candidate_id").columns
        rows = placed.select("resume_id", "candidate_id", *cards).withColumn("card_json", F.to_json(F.struct(*cards)))
        resumes = rows.select("resume_id", "candidate_id", "source_file", "file_type", "file_sha256", merging.resume_date(F.col("experiences"), F.col("parsed_at")).alias("resume_date"), "card_json")
        jobs = rows.select("resume_id", "candidate_id", F.explode("experiences").alias("e")).select("resume_id", "candidate_id", "e.company", "e.title", "e.start", "e.end")
        added = {"resumes": resumes, "experiences": jobs, "tags": self._tags(rows), "conflicts": self._conflicts(placed)}
        if contents is not None:
            added["originals"] = contents.join(placed.select("source_file", "file_sha256"), "source_file")
        candidates, added = stored(self._candidates(placed, jobs), "candidates"), {n: stored(df, n) for n, df in added.items()}
        added |= self._indexed(placed.select("candidate_id").distinct(), candidates, *(self.table(n).unionByName(added[n]) for n in ("tags", "experiences")))
        self.commit({"candidates": candidates}, added)

    def _indexed(self, ids: DataFrame, candidates: DataFrame, tags: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
        """What the search index gains by a change of the people of ids: a new version of their documents (empty for who is gone) and its postings."""
        known = self._manifests()
        own = [t.join(ids, "candidate_id", "left_semi") for t in (candidates, tags, jobs)]
        docs = ids.join(search.search_documents(*own, key="candidate_id"), "candidate_id", "left").withColumn("version", F.lit((known[-1] if known else 0) + 1).cast("bigint"))
        docs = stored(docs.select(*(x.split()[0] for x in TABLES["documents"].split(", "))), "documents")
        return {"documents": docs, "postings": search.postings(docs, search.COLUMNS, "candidate_id")}

    def _tags(self, rows: DataFrame) -> DataFrame:
        """New tags of people. A tag's name is there once: the kind that brought it first is its kind for all."""
        tag = lambda place, kind, c: rows.select("candidate_id", F.struct("resume_id", F.lit(place).alias("place"), F.lit(kind).alias("kind")).alias("by"), F.explode(F.col(f"{c}.value")).alias("tag"))
        new = tag(0, "skill", "skills").unionByName(tag(1, "certificate", "certificates"))
        first = new.groupBy("tag").agg(F.min("by")["kind"].alias("new_kind"))
        held = self.table("tags")
        kinds = first.join(held.groupBy("tag").agg(F.min("kind").alias("old_kind")), "tag", "left").select("tag", F.coalesce("old_kind", "new_kind").alias("kind"))
        out = new.select("candidate_id", "tag").distinct().join(kinds, "tag")
        return out.join(held.select("candidate_id", "tag"), ["candidate_id", "tag"], "left_anti")

    def _values(self, placed: DataFrame) -> DataFrame:
        """One row for each version: candidate_id, fields, freshness, resume_id (0 for what the store holds)."""
        new = placed.select("candidate_id", *(blank_to_null(F.col("fields")[f]["value"]).alias(f) for f in SCALAR_FIELDS), merging.freshness(F.col("experiences"), F.col("parsed_at")).alias("f"), "resume_id")
        old = self.table("candidates").select("candidate_id", *SCALAR_FIELDS, F.struct("latest", F.col("n_jobs").alias("n"), "parsed_at").alias("f"), F.col("latest_resume_id").alias("resume_id"))
        return new.unionByName(old)

    def _candidates(self, placed: DataFrame, jobs: DataFrame) -> DataFrame:
        values = self._values(placed)
        latest = merging.latest_values(values, ["candidate_id"], SCALAR_FIELDS, F.struct("f", "resume_id"))
        newest = values.groupBy("candidate_id").agg(F.max(F.struct("f", "resume_id")).alias("x")).select("candidate_id", F.col("x.resume_id").alias("latest_resume_id"), "x.f.latest", F.col("x.f.n").alias("n_jobs"), "x.f.parsed_at")
        all_jobs = self.table("experiences").select("candidate_id", "start", "end").unionByName(jobs.select("candidate_id", "start", "end"))
        years = intervals.spans(intervals.month_intervals(all_jobs, ["candidate_id"]), ["candidate_id"]).select("candidate_id", "years")
        return latest.join(newest, "candidate_id").join(years, "candidate_id", "left")

    def _conflicts(self, placed: DataFrame) -> DataFrame:
        """Pending conflicts: fields that the versions of a person contradict in, and people that may be one."""
        versions = self._values(placed)
        pairs = versions.alias("x").join(versions.alias("y"), F.expr("x.candidate_id = y.candidate_id and x.resume_id < y.resume_id")).select(
            F.col("x.candidate_id").alias("candidate_id"), F.struct(*(F.col(f"x.{f}") for f in SCALAR_FIELDS)).alias("pa"), F.struct(*(F.col(f"y.{f}") for f in SCALAR_FIELDS)).alias("pb"))
        fields = merging.conflicts(pairs).select("candidate_id", "field", "option_a", "option_b")
        reviews = placed.where("review_id is not null").select("candidate_id", F.lit(PENDING_MERGE).alias("field"), F.col("review_id").cast("string").alias("option_a"), F.col("candidate_id").cast("string").alias("option_b")).distinct()
        rows = fields.unionByName(reviews).distinct().withColumn("chosen", F.lit(None).cast("string")).withColumn("status", F.lit("pending"))
        rows = rows.withColumn("conflict_id", F.md5(F.concat_ws("|", F.col("candidate_id").cast("string"), "field", "option_a", "option_b")))
        return rows.join(self.table("conflicts").select("conflict_id"), "conflict_id", "left_anti")

    # --- reading ---

    def _as_people(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        people = self.table("candidates").withColumnRenamed("candidate_id", "pid").withColumnRenamed("desired_position", "desired")
        return people, self.table("tags").withColumnRenamed("candidate_id", "pid"), self.table("experiences").withColumnRenamed("candidate_id", "pid")

    def search(self, query: str = "", masked: bool | None = None, **filters) -> DataFrame:
        """Candidates that match; a query of three characters or more reads the kept index."""
        people, tags, jobs = self._as_people()
        q, keys = (query or "").strip(), None
        if len(q) >= 3:
            keys = search.find(self.table("postings"), self.table("documents"), q, "candidate_id").withColumnRenamed("candidate_id", "pid")
        found = search.search(people, tags, jobs, query, found=keys, **filters)
        if masked if masked is not None else self.masking():
            found = found.withColumn("phone", mask_phone(F.col("phone"))).withColumn("email", mask_email(F.col("email")))
        return found

    def timeline(self, candidate_id: int) -> DataFrame:
        """One row: the candidate, and arrays of resumes (by date), experiences (by resume and start) and tags (by kind and name)."""
        one = lambda name: self.table(name).where(F.col("candidate_id") == candidate_id)
        resumes = one("resumes").groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("resume_date", "resume_id", "source_file"))).alias("resumes"))
        jobs = one("experiences").groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("resume_id", "start", "end", "company", "title"))).alias("experiences"))
        tags = one("tags").groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("kind", "tag"))).alias("tags"))
        return one("candidates").join(resumes, "candidate_id", "left").join(jobs, "candidate_id", "left").join(tags, "candidate_id", "left")

    def screen(self, condition: dict) -> DataFrame:
        people, tags, jobs = self._as_people()
        skills = tags.where("kind = 'skill'").groupBy("pid").agg(F.array_sort(F.collect_set("tag")).alias("skills"))
        part = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).alias("text"))
        worked = jobs.groupBy("pid").agg(F.flatten(F.collect_list(F.array(part("company"), part("title")))).alias("worked"))
        own = F.array(part("school"), part("major"), F.struct(F.lit("desired_position").alias("field"), F.col("desired").alias("text")))
        rows = people.join(skills, "pid", "left").join(worked, "pid", "left").join(self._skill_evidence(), "pid", "left")
        rows = rows.withColumn("has_jobs", F.col("worked").isNotNull()).withColumn("texts", F.concat(own, F.coalesce("worked", F.array().cast("array<struct<field:string,text:string>>"))))
        return screening.matrix(rows, condition)

    def _skill_evidence(self) -> DataFrame:
        """pid, skill_evidence: by lower-case skill, the lines of all resumes that show it."""
        card = F.from_json("card_json", f"skills ARRAY<{FIELD}>")["skills"]
        each = self.table("resumes").select(F.col("candidate_id").alias("pid"), F.explode(card).alias("s")).select("pid", F.lower(strip(F.col("s.value"))).alias("skill"), F.explode("s.evidence").alias("e"))
        one = each.where("skill is not null").groupBy("pid", "skill").agg(F.array_sort(F.collect_set("e")).alias("e"))
        return one.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("skill", "e"))).alias("skill_evidence"))

    # --- conflicts ---

    def pending_reviews(self) -> DataFrame:
        return self.table("conflicts").where("status = 'pending'").orderBy("candidate_id", "field")

    def resolve_conflict(self, conflict_id: str, chosen: str) -> bool:
        """Chooses one of a pending field conflict's options and sets the field; people that may be one are kept apart by `separate`."""
        row = self.table("conflicts").where((F.col("conflict_id") == conflict_id) & (F.col("status") == "pending")).first()
        if row is None:
            return False
        if chosen not in (("separate",) if row.field == PENDING_MERGE else (row.option_a, row.option_b)):
            raise ValueError("choose one of the options")
        changed = {}
        if row.field != PENDING_MERGE:
            rows = self.table("candidates")
            changed["candidates"] = rows.withColumn(row.field, F.when(F.col("candidate_id") == row.candidate_id, F.lit(chosen)).otherwise(F.col(row.field)))
        now = F.col("conflict_id") == conflict_id
        rows = self.table("conflicts")
        changed["conflicts"] = rows.withColumn("chosen", F.when(now, F.lit(chosen)).otherwise(F.col("chosen"))).withColumn("status", F.when(now, "resolved").otherwise(F.col("status")))
        with storage.scope() as paths:
            ids = self.table("candidates").where(F.col("candidate_id") == row.candidate_id).select("candidate_id")
            self.commit(changed, self._indexed(ids, changed["candidates"], self.table("tags"), self.table("experiences")) if "candidates" in changed else None)
            self._let_go(paths)
        return True

    def merge_candidates(self, source: int, target: int) -> None:
        """Everything of source goes to target; fields are those of the fresher, filled from the other."""
        ids = {r[0] for r in self.table("candidates").where(F.col("candidate_id").isin(source, target)).select("candidate_id").collect()}
        if ids != {source, target} or source == target:
            raise ValueError("two candidates of the store are merged")
        with storage.scope() as paths:
            self._merge(source, target)
            self._let_go(paths)

    def _merge(self, source: int, target: int) -> None:
        mapping = self.spark.createDataFrame([(source, target)], "source bigint, target bigint")
        values = merging.remap(self.table("candidates"), "candidate_id", mapping)
        f = F.struct("latest", "n_jobs", "parsed_at", "latest_resume_id")
        latest = merging.latest_values(values, ["candidate_id"], SCALAR_FIELDS, f)
        newest = values.groupBy("candidate_id").agg(F.max(f).alias("x")).select("candidate_id", "x.latest_resume_id", "x.latest", "x.n_jobs", "x.parsed_at")
        moved = {n: stored(merging.remap(self.table(n), "candidate_id", mapping), n) for n in ("resumes", "experiences", "tags", "conflicts")}
        years = intervals.spans(intervals.month_intervals(moved["experiences"].select("candidate_id", "start", "end"), ["candidate_id"]), ["candidate_id"]).select("candidate_id", "years")
        candidates = stored(latest.join(newest, "candidate_id").join(years, "candidate_id", "left"), "candidates")
        pair = F.col("option_a").isin(str(source), str(target)) & F.col("option_b").isin(str(source), str(target))
        over = (F.col("field") == PENDING_MERGE) & pair & (F.col("status") == "pending")
        moved["conflicts"] = moved["conflicts"].withColumn("chosen", F.when(over, "merge").otherwise(F.col("chosen"))).withColumn("status", F.when(over, "resolved").otherwise(F.col("status")))
        moved["tags"] = moved["tags"].distinct()
        ids = self.spark.createDataFrame([(source,), (target,)], "candidate_id bigint")
        self.commit(moved | {"candidates": candidates}, self._indexed(ids, candidates, moved["tags"], moved["experiences"]))

    # --- settings and purge ---

    def setting(self, key: str, default: str | None = None) -> str | None:
        row = self.table("settings").where(F.col("k") == key).first()
        return row.v if row else default

    def set_setting(self, key: str, value: str) -> None:
        self.replace("settings", merging.upsert(self.table("settings"), self.spark.createDataFrame([(key, value)], "k string, v string"), ["k"]))

    def masking(self) -> bool:
        return self.setting("masking", "on") == "on"

    def purge_preview(self) -> dict[str, int]:
        return {name: self.table(name).count() for name in PEOPLE}

    def purge(self) -> dict[str, int]:
        """Removes all people and what belongs to them, reports of imports and scratch tables included; settings stay. Returns what was removed."""
        removed = self.purge_preview()
        for _ in range(2):  # the second manifest lets go of the folders that the first one's predecessor names
            self.commit(emptied=PEOPLE)
        storage.release(self.spark, self._results)
        self._results.clear()
        return removed
