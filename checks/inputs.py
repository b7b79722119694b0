"""The package's input tables, derived by Spark from the given tables.

Every row of the given tables takes part. Flags, defects and what was delivered before follow from keys by fixed rules,
so that the SQL twins in ``checks.oracles`` can state the same rules.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postwatch import session
from postwatch.operators import changes, digest, matching, postings as posting_ops, profiles, subscriptions
from postwatch.plans import poll
from postwatch.plans.daily import Scoring
from postwatch.sinks import runs, users

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SECRET = "fixture"
CONFIRM_BASE = "https://alerts.example.org"
UNSUBSCRIBE_BASE = "https://alerts.example.org/unsubscribe"
DAY = "2024-06-01"
GREETINGS = ["New postings for you.", "Today's postings."]
KEYWORDS = ["free", "pills", "nicht"]
BLOCKED = ["cheap-pills", "spam-farm"]
MARKER = "/en/"
PAIRS = (("requirements", "skills"),)
# Orders per landed response, a bound given by the order key being unique.
KEYS_PER_RESPONSE = 1250


# Schemas of the given tables: reading footers to learn them would cost a job per scan.
GIVEN = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "pages": "page_id long, url string, html string",
}


_BUILT_ONCE = ["people", "users", "profiles", "postings", "responses", "top", "candidates", "scored", "ledger", "feed", "requests", "queue"]


_polled: dict[tuple[str, str], str] = {}


class Inputs:
    """Lazy tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.given = functools.cache(self._read)
        for name in _BUILT_ONCE:
            setattr(self, name, functools.cache(getattr(self, name)))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(GIVEN[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    # --- subscriptions -------------------------------------------------------------------------------------------

    def people(self) -> DataFrame:
        nation = self.given("nation")
        return self.given("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))

    def users(self) -> DataFrame:
        no = F.col("c_custkey")
        return self.people().select(
            no.cast("string").alias("id"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit("@example.org")).alias("email"),
            F.col("c_mktsegment").alias("position"),
            F.col("n_name").alias("location"),
            F.when(F.col("c_acctbal") < 0, "part-time").otherwise("full-time").alias("job_type"),
            (no % 4 == 0).alias("is_new"),
            (no % 5 != 1).alias("is_confirmed"),
            F.when(no % 5 == 1, F.concat(F.lit("tok-"), no.cast("string"))).alias("confirmation_token"),
        )

    def _bought(self) -> DataFrame:
        """(o_custkey, l_orderkey, p_brand, p_type) for every line with its order and part. Lines meet their orders first, while
        they are but two numbers."""
        parts = self.given("part").select("p_partkey", "p_brand", "p_type")
        lines = self.given("lineitem").select("l_orderkey", "l_partkey")
        orders = self.given("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))

    def skills(self, held: DataFrame | None = None) -> DataFrame:
        """``held``: customers with their brands, each pair once, where they are worked out already."""
        rows = self._bought().select("o_custkey", "p_brand").distinct() if held is None else held
        number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        return rows.select(
            number.alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("p_brand").alias("skill")
        )

    def experiences(self, held: DataFrame | None = None) -> DataFrame:
        rows = self._bought().select("o_custkey", "p_type").distinct() if held is None else held
        return rows.select(
            F.length("p_type").alias("id"), F.col("o_custkey").cast("string").alias("user_id"),
            F.col("p_type").alias("experience"),
        )

    def educations(self) -> DataFrame:
        rows = self.given("orders").select("o_custkey", "o_orderpriority").distinct()
        return rows.select(
            F.substring("o_orderpriority", 1, 1).cast("int").alias("id"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("o_orderpriority").alias("education"),
        )

    def profiles(self) -> DataFrame:
        """The three tables folded; lines are read and joined once for skills and experiences together."""
        number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        both = F.array(profiles.entry("skills", number, F.col("p_brand")), profiles.entry("experiences", F.length("p_type"), F.col("p_type")))
        user = F.col("o_custkey").cast("string").alias("user_id")
        learnt = profiles.entry("qualifications", F.substring("o_orderpriority", 1, 1).cast("int"), F.col("o_orderpriority"))
        bought = self._bought().select(user, F.inline(both))
        return profiles.fold_stacked(bought.unionByName(self.given("orders").select(user, F.inline(F.array(learnt)))).distinct())

    # --- postings ------------------------------------------------------------------------------------------------

    def postings(self) -> DataFrame:
        key = F.col("o_orderkey")
        title = F.concat(F.col("o_orderpriority"), F.lit(" order "), key.cast("string"))
        rows = self.given("orders").join(self.people(), F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(
            F.col("c_mktsegment").alias("position"),
            F.col("n_name").alias("location"),
            key.alias("pos"),
            title.alias("title"),
            F.col("c_name").alias("company"),
            F.col("n_name").alias("job_location"),
            F.concat(F.lit("https://jobs.example.org/"), key.cast("string")).alias("link"),
            F.when(key % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_posted"),
            F.col("o_orderstatus").alias("employment_type"),
            F.when(key % 11 == 0, "")
            .otherwise(F.concat(title, F.lit(" for "), F.col("c_name"), F.lit(", status "), F.col("o_orderstatus")))
            .alias("description"),
        )

    def requirements(self) -> DataFrame:
        """(link, requirements) of the postings at the top of a search: the distinct brands of the order, so at most as
        many as there are brands. Lines are cut down to those postings before they are looked up in ``part``.
        """
        parts = self.given("part").select("p_partkey", "p_brand")
        lines = self.given("lineitem").select("l_orderkey", "l_partkey")
        asked = self.top().select(F.col("pos").alias("l_orderkey"))
        brands = lines.join(asked, "l_orderkey", "left_semi").join(parts, F.col("l_partkey") == F.col("p_partkey"))
        folded = brands.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("requirements"))
        link = F.concat(F.lit("https://jobs.example.org/"), F.col("l_orderkey").cast("string"))
        return folded.select(link.alias("link"), "requirements")

    def landed_responses(self) -> DataFrame:
        """(position, location, chunk, first_pos, body): postings as JSON documents, some of them defective."""
        chunked = self.postings().withColumn("chunk", F.floor(F.col("pos") / KEYS_PER_RESPONSE))
        sent_link = F.when(
            F.col("pos") % 2 == 0, F.concat(F.lit("HTTPS://Jobs.Example.ORG:443/"), F.col("pos").cast("string"))
        ).otherwise(F.col("link"))
        job = F.struct(
            "pos",
            F.when(F.col("pos") % 3 == 0, F.concat(F.lit("  "), F.col("title"), F.lit("\t"))).otherwise(F.col("title")).alias("title"),
            "company", F.col("job_location").alias("location"), sent_link.alias("link"),
            F.col("date_posted").alias("datePosted"), F.col("employment_type").alias("employmentType"),
            F.coalesce(F.nullif("description", F.lit("")), F.lit("none given")).alias("description"),
        )
        grouped = chunked.groupBy("position", "location", "chunk").agg(
            F.min("pos").alias("first_pos"), F.array_sort(F.collect_list(job)).alias("jobs")
        )
        query = F.concat("position", F.lit(" jobs in "), "location")
        text = F.to_json(F.struct(query.alias("query"), "jobs", F.lit(1000).alias("originalHtmlLength")))
        first_title = '^(.*?"title":)"[^"]*"'
        defect = F.col("first_pos") % 10
        body = (
            F.when(defect == 0, F.regexp_replace(text, first_title, '$1" x "'))
            .when(defect == 5, F.regexp_replace(text, first_title, "$1 5"))
            .when(defect.isin(1, 6), F.replace(text, F.lit('"jobs":'), F.lit('"results":')))
            .when(defect == 4, F.expr("substring(_text, 1, length(_text) - 3)"))
            .when(defect == 2, F.replace(text, F.lit('"datePosted"'), F.lit('"date_posted"')))
            .otherwise(F.col("_text"))
        )
        return grouped.withColumn("_text", text).select("position", "location", "chunk", "first_pos", body.alias("body"))

    def responses(self) -> DataFrame:
        return posting_ops.parse_responses(self.landed_responses())

    # --- candidates ----------------------------------------------------------------------------------------------

    def top(self) -> DataFrame:
        return matching.one_per_link(matching.top_per_search(matching.with_text_flag(self.postings())))

    def candidates(self) -> DataFrame:
        users = self.users()
        return matching.candidates(subscriptions.confirmed(users), self.top())

    def scored(self) -> DataFrame:
        """Candidates with lists and overlap score."""
        users = subscriptions.confirmed(self.users())
        top = matching.with_requirements(self.top(), self.requirements())
        cands = matching.candidates(profiles.attach(users, self.profiles()), top, counted=users)
        return matching.overlap_scores(cands, list(PAIRS))

    def ledger(self) -> DataFrame:
        """What earlier runs delivered: candidates picked by a rule over both keys."""
        sent = self.candidates().where((F.col("user_id").cast("long") * 31 + F.col("pos") * 17) % 4 == 0)
        return digest.ledger_rows(sent)

    def landed_scores(self) -> DataFrame:
        """(user_id, link, body): a score response per scored candidate, some cut short."""
        nothing = F.array().cast("array<string>")
        requirements = F.struct(F.col("requirements").alias("skills"), nothing.alias("experiences"))
        profile = F.struct("skills", "experiences", "qualifications")
        doc = F.struct(
            requirements.alias("jobRequirements"), profile.alias("userProfile"),
            F.struct("score").alias("similarityScore"),
        )
        rows = self.scored().where("score IS NOT NULL").withColumn("_text", F.to_json(doc))
        cut = F.expr("substring(_text, 1, length(_text) - 4)")
        return rows.select("user_id", "link", F.when(F.col("pos") % 13 == 0, cut).otherwise(F.col("_text")).alias("body"))

    def relanded_scores(self) -> DataFrame:
        """(user_id, link, run, body): every scored candidate lands in run 1; by key some again in run 2 with half the score, some of these
        twice, and in either run some are cut short."""
        profile = F.struct("skills", "experiences", "qualifications")
        runs = F.when(F.col("pos") % 6 == 0, F.array(F.lit(1), F.lit(2), F.lit(2))).when(F.col("pos") % 3 == 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1)))
        rows = self.scored().where("score IS NOT NULL").select("*", F.explode(runs).alias("run"))
        score = F.struct((F.col("score") / F.col("run")).alias("score"))
        rows = rows.withColumn("_text", F.to_json(F.struct(F.struct(F.col("requirements").alias("skills")).alias("jobRequirements"), profile.alias("userProfile"), score.alias("similarityScore"))))
        cut = F.when(F.col("run") == 1, F.col("pos") % 13 == 0).otherwise(F.col("pos") % 5 == 0)
        short = F.expr("substring(_text, 1, length(_text) - 4)")
        return rows.select("user_id", "link", F.col("run").cast("string").alias("run"), F.when(cut, short).otherwise(F.col("_text")).alias("body"))

    def scoring(self) -> Scoring:
        return Scoring(requirements=self.requirements(), pairs=PAIRS)

    # --- change requests -----------------------------------------------------------------------------------------

    def feed(self) -> DataFrame:
        """(seq, kind, body): signups, errors and purchases as add, delete and confirm requests, other events under their own name."""
        people = self.users().select(F.col("id").alias("_id"), "email", F.col("position").alias("_p"), F.col("location").alias("_l"))
        # merged: customers may lie in one file split, and with the events sent to them one task would make and parse all requests
        rows = self.given("events").join(people.hint("merge"), F.col("user_id").cast("string") == F.col("_id"))
        no = F.col("event_id")
        segment = F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (no % 5 + 1).cast("int"))
        nation = F.concat(F.lit("NATION_"), (no % 25).cast("string"))
        own, gap = no % 4 == 0, no % 9 == 0
        position = F.when(own, F.col("_p")).otherwise(segment)
        location = F.when(own, F.col("_l")).otherwise(nation)

        def brand(n: int) -> Column:
            return F.concat(F.lit("Brand#"), (no % n).cast("string"))

        add = F.to_json(
            F.struct(
                "email", position.alias("position"), location.alias("location"),
                F.when(~gap, "full-time").alias("jobType"), F.array(brand(25), brand(7)).alias("skills"),
                F.array(brand(3)).alias("experience"),
            )
        )
        drop = F.to_json(F.struct("email", F.when(~gap, position).alias("position"), location.alias("location")))
        token = F.concat(F.lit("tok-"), F.col("user_id").cast("string"))
        sure = F.to_json(F.struct(F.when(~gap, token).alias("token")))
        named = {"signup": "add", "error": "delete", "purchase": "confirm"}
        kind = F.coalesce(*[F.when(F.col("event_type") == event, F.lit(name)) for event, name in named.items()], F.col("event_type"))
        text = F.when(kind == "add", add).when(kind == "delete", drop).otherwise(sure)
        return rows.select(no.alias("seq"), kind.alias("kind"), text.alias("_text")).select(
            "seq", "kind",
            F.when(F.col("seq") % 17 == 0, F.expr("substring(_text, 1, length(_text) - 2)")).otherwise(F.col("_text")).alias("body"),
        )

    def requests(self) -> DataFrame:
        return changes.valid(changes.parse(self.feed()))

    def token(self) -> Column:
        return subscriptions.secret_token(SECRET, F.col("email"), F.col("position"), F.col("location"), F.col("seq").cast("string"))

    # --- pages and queues ----------------------------------------------------------------------------------------

    def pages(self) -> DataFrame:
        """The given pages; by key, some have their article renamed, a table or a description added, or a challenge's title."""
        no, page = F.col("page_id"), F.col("html")
        page = F.when(no % 4 == 1, F.replace(page, F.lit("<article"), F.lit("<section"))).otherwise(page)
        page = F.when(no % 3 == 0, F.concat(page, F.lit("<table class='t'></table>"))).otherwise(page)
        page = F.when(no % 5 == 0, F.concat(page, F.lit('<div class="b" id="jobDescriptionText">x</div>'))).otherwise(page)
        page = F.when(no % 7 == 0, F.replace(page, F.lit("<title>"), F.lit("<title>Just a moment... "))).otherwise(page)
        return self.given("pages").withColumn("html", page)

    def queue(self) -> DataFrame:
        """(pos, job_url, note): every page URL, some a second time."""
        again = F.when(F.col("page_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        rows = self.pages().select("page_id", "url", F.explode(again).alias("copy"))
        note = F.concat(F.lit("copy "), F.col("copy").cast("string"))
        return rows.select((F.col("page_id") * 2 + F.col("copy")).alias("pos"), F.col("url").alias("job_url"), note.alias("note"))

    def processed(self) -> DataFrame:
        return self.pages().where("page_id % 3 = 0").select(F.col("url").alias("job_url"))


    # --- stores --------------------------------------------------------------------------------------------------

    def polled(self) -> str:
        """The folder of a user store that a poll over the whole feed has changed: users and children written, one poll, compaction."""
        own = (self.spark.sparkContext.applicationId, self.sf_dir)
        if own in _polled:
            return _polled[own]
        root = f"{session.shared_dir(self.spark)}/checks-{uuid.uuid4().hex[:12]}"
        users.write(self.users(), None, root, "0")
        # lines are read and joined once for both lists
        lists = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("p_brand", "p_type")])
        held = runs.staged(self._bought().select("o_custkey", F.inline(lists)).distinct(), f"{root}/held")
        brands, types = (held.where(F.col("kind") == c).select("o_custkey", F.col("value").alias(c)) for c in ("p_brand", "p_type"))
        for name, table in zip(users.CHILDREN, (self.skills(brands), self.experiences(types), self.educations())):
            users.write_children(table, root, name, "0")
        settings = poll.PollSettings(root, SECRET, CONFIRM_BASE, UNSUBSCRIBE_BASE, lambda searches: self.postings(), buckets=8)
        poll.poll(self.spark, self.feed(), "1", DAY, settings)
        poll.compact(self.spark, root, before="1")
        _polled[own] = root
        return root


def overlap_function(fails: bool = False) -> Callable[[pd.DataFrame], pd.Series]:
    """The overlap score as a caller-supplied function; missing where an order has no requirements. With ``fails`` it raises
    for postings whose ``pos`` ends in 3.

    Made here rather than defined at module level, so that it is shipped by value: workers need not have this module.
    """
    series = pd.Series

    def one(needed, own) -> float | None:
        wanted = set(needed) if needed is not None else set()
        return len(wanted & set(own)) / len(wanted) if wanted else None

    def score(batch):
        if fails and (batch["pos"] % 10 == 3).any():
            raise ValueError("no score for these postings")
        found = [one(needed, own) for needed, own in zip(batch["requirements"], batch["skills"])]
        return series(found, index=batch.index, dtype="float64")

    return score
