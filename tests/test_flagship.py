"""The counts of every step of the daily digest at sf0.01, worked out by SQL on the given tables."""

from pyspark.sql import functions as F

from checks import inputs as given
from postwatch import session
from postwatch.operators import digest, matching, profiles, subscriptions
from postwatch.plans import daily


def test_counts_of_every_step(spark):
    t = given.Inputs(session.configure(spark), "/root/testdata/sf0.01")
    assert t.users().count() == 1500 and subscriptions.confirmed(t.users()).count() == 1200
    assert t.postings().count() == 15000 and t.top().count() == 1250
    assert matching.search_keys(t.users()).count() == 125
    assert t.candidates().count() == 12000 and t.ledger().count() == 2913
    fresh = matching.unsent(t.scored(), t.ledger())
    steps = fresh.agg(
        F.count("*"), F.count("score"), F.count_if(F.col("score") < 0.35), F.count_if(matching.matches())
    ).first()
    assert tuple(steps) == (9087, 8859, 784, 8369)
    assert profiles.attach(t.users(), t.profiles()).where("has_profile").count() == 1500
    ranked = daily.daily_digest(t.users(), t.profiles(), t.postings(), t.ledger(), t.scoring())
    assert ranked.count() == 8369 and digest.sizes(ranked).count() == 1199
    outcomes = {r.outcome: r["count"] for r in matching.outcomes(t.scored(), t.ledger()).groupBy("outcome").count().collect()}
    assert outcomes == {"already_sent": 2913, "below_threshold": 718, "passed": 7360, "unscored": 1009}
