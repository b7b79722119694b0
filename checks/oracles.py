"""The SQL twin of every query, for DuckDB on the same tables.

They state the input rules of ``checks.inputs`` once more, from the source tables: where a query parses JSON, its twin
works out the surviving rows without any JSON.
"""

from __future__ import annotations

from checks import inputs as given
from postwatch.functions import render

_SEGMENTS = "[" + ", ".join(f"'{s}'" for s in given.SEGMENTS) + "]"
_GREETINGS = "[" + ", ".join("'" + g.replace("'", "''") + "'" for g in given.GREETINGS) + "]"


def _escaped(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        text = f"replace({text}, '{raw}', '{safe}')"
    return text


# Common table expressions; each names what it is made from, and only those needed are put before a query.
_CTES: dict[str, str] = {
    "users": """
        SELECT c_custkey::VARCHAR AS id, lower(replace(c_name, '#', '-')) || '@example.org' AS email,
               c_mktsegment AS position, n_name AS location,
               CASE WHEN c_acctbal < 0 THEN 'part-time' ELSE 'full-time' END AS job_type,
               c_custkey % 4 = 0 AS is_new, c_custkey % 5 <> 1 AS is_confirmed,
               CASE WHEN c_custkey % 5 = 1 THEN 'tok-' || c_custkey END AS confirmation_token
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "bought": """
        SELECT o_custkey, p_brand, p_type
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "skills": """
        SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)', 1)::INTEGER AS id, o_custkey::VARCHAR AS user_id, p_brand AS skill
        FROM bought""",
    "experiences": """
        SELECT DISTINCT length(p_type) AS id, o_custkey::VARCHAR AS user_id, p_type AS experience
        FROM bought""",
    "educations": """
        SELECT DISTINCT substr(o_orderpriority, 1, 1)::INTEGER AS id, o_custkey::VARCHAR AS user_id, o_orderpriority AS education
        FROM orders""",
    "skill_lists": "SELECT user_id, string_agg(skill, '|' ORDER BY id, skill) AS skills FROM skills GROUP BY user_id",
    "experience_lists": "SELECT user_id, string_agg(experience, '|' ORDER BY id, experience) AS experiences FROM experiences GROUP BY user_id",
    "education_lists": "SELECT user_id, string_agg(education, '|' ORDER BY id, education) AS qualifications FROM educations GROUP BY user_id",
    "profile_ids": "SELECT user_id FROM skills UNION SELECT user_id FROM experiences UNION SELECT user_id FROM educations",
    "postings": """
        SELECT c_mktsegment AS position, n_name AS location, o_orderkey AS pos,
               o_orderpriority || ' order ' || o_orderkey AS title, c_name AS company, n_name AS job_location,
               'https://jobs.example.org/' || o_orderkey AS link,
               CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_posted,
               o_orderstatus AS employment_type,
               CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority || ' order ' || o_orderkey || ' for ' || c_name
                 || ', status ' || o_orderstatus END AS description
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "responses": f"""
        SELECT *, pos // {given.KEYS_PER_RESPONSE} AS chunk,
               min(pos) OVER (PARTITION BY position, location, pos // {given.KEYS_PER_RESPONSE}) AS first_pos,
               row_number() OVER (PARTITION BY position, location, pos // {given.KEYS_PER_RESPONSE} ORDER BY pos) AS place
        FROM postings""",
    "top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY position, location ORDER BY pos)::INTEGER AS search_rank FROM postings)
        WHERE search_rank <= 10""",
    "candidates": """
        SELECT u.id AS user_id, u.email, u.position, u.location, t.link, t.pos, t.date_posted, t.title, t.company, t.job_location, t.description
        FROM users u JOIN top t ON u.position = t.position AND u.location = t.location WHERE u.is_confirmed""",
    "ledger": """
        SELECT email, link AS job_url, position, location FROM candidates WHERE (user_id::BIGINT * 31 + pos * 17) % 4 = 0""",
    "unsent": """
        SELECT c.* FROM candidates c WHERE NOT EXISTS (
            SELECT 1 FROM ledger l WHERE l.email = c.email AND l.job_url = c.link
                                     AND l.position = c.position AND l.location = c.location)""",
    "needed": """
        SELECT DISTINCT 'https://jobs.example.org/' || l_orderkey AS link, p_brand AS requirement
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "hits": """
        SELECT c.user_id, c.link, count(s.skill) AS matched, count(*) AS wanted
        FROM candidates c JOIN profile_ids p ON p.user_id = c.user_id JOIN needed n ON n.link = c.link
        LEFT JOIN skills s ON s.user_id = c.user_id AND s.skill = n.requirement GROUP BY c.user_id, c.link""",
    "scores": "SELECT user_id, link, matched::DOUBLE / wanted::DOUBLE AS score FROM hits",
    "newest_scores": """
        SELECT user_id, link, CASE WHEN NOT bad THEN score / run END AS score, CASE WHEN bad THEN 'bad_json' END AS score_error
        FROM (SELECT *, CASE WHEN run = 2 THEN pos % 5 = 0 ELSE pos % 13 = 0 END AS bad
              FROM (SELECT *, CASE WHEN pos % 3 = 0 THEN 2 ELSE 1 END AS run
                    FROM (SELECT *, substr(link, length('https://jobs.example.org/') + 1)::BIGINT AS pos FROM scores)))""",
    "kept": """
        SELECT u.*, s.score FROM unsent u LEFT JOIN scores s ON s.user_id = u.user_id AND s.link = u.link
        WHERE s.score IS NULL OR u.description = '' OR NOT s.score < 0.35""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(date_posted, '') DESC, pos)::INTEGER AS card_no FROM kept""",
    "feed": f"""
        SELECT event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'confirm' ELSE event_type END AS kind,
               u.email AS own_email, 'tok-' || e.user_id AS own_token,
               CASE WHEN event_id % 4 = 0 THEN u.position ELSE {_SEGMENTS}[event_id % 5 + 1] END AS any_position,
               CASE WHEN event_id % 4 = 0 THEN u.location ELSE 'NATION_' || (event_id % 25) END AS any_location
        FROM events e JOIN users u ON u.id = e.user_id::VARCHAR""",
    "parsed": """
        SELECT seq, kind, CASE WHEN kind IN ('add', 'delete') THEN own_email END AS email,
               CASE WHEN kind = 'add' OR (kind = 'delete' AND seq % 9 <> 0) THEN any_position END AS position,
               CASE WHEN kind IN ('add', 'delete') THEN any_location END AS location,
               CASE WHEN kind = 'add' AND seq % 9 <> 0 THEN 'full-time' END AS job_type,
               CASE WHEN kind NOT IN ('add', 'delete') AND seq % 9 <> 0 THEN own_token END AS token,
               CASE WHEN kind = 'add' THEN 'Brand#' || (seq % 25) || '|' || 'Brand#' || (seq % 7) END AS skills,
               CASE WHEN kind = 'add' THEN 'Brand#' || (seq % 3) END AS experience,
               CASE WHEN seq % 17 = 0 THEN 'bad_json' WHEN kind IN ('view', 'click') THEN 'unknown_kind' WHEN seq % 9 = 0 THEN
                    CASE kind WHEN 'add' THEN 'missing_jobType' WHEN 'delete' THEN 'missing_position' ELSE 'missing_token' END
               END AS reject_reason
        FROM feed""",
    "requests": "SELECT * FROM parsed WHERE reject_reason IS NULL",
    "accepted": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email, position, location ORDER BY seq) AS rn
                       FROM requests WHERE kind = 'add') a
        WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM users u WHERE u.email = a.email AND u.position = a.position
                                                             AND u.location = a.location)""",
    "gone": "SELECT email, position, location, max(seq) AS last_delete FROM requests WHERE kind = 'delete' GROUP BY ALL",
    "kept_users": """
        SELECT u.* FROM users u LEFT JOIN gone g ON u.email = g.email AND u.position = g.position AND u.location = g.location
        WHERE g.email IS NULL""",
    "standing": """
        SELECT * FROM (
            SELECT a.*, g.last_delete, row_number() OVER (PARTITION BY a.email, a.position, a.location ORDER BY a.seq) AS rn
            FROM requests a LEFT JOIN gone g ON a.email = g.email AND a.position = g.position AND a.location = g.location
            WHERE a.kind = 'add' AND (g.last_delete IS NULL OR a.seq > g.last_delete)) s
        WHERE rn = 1 AND (last_delete IS NOT NULL OR NOT EXISTS (
            SELECT 1 FROM users u WHERE u.email = s.email AND u.position = s.position AND u.location = s.location))""",
    "polled": """
        SELECT email, position, location, job_type, is_new, is_confirmed OR t.token IS NOT NULL AS is_confirmed,
               confirmation_token IS NOT NULL AND t.token IS NULL AS holds_token
        FROM (SELECT email, position, location, job_type, is_new, is_confirmed, confirmation_token FROM kept_users
              UNION ALL SELECT email, position, location, job_type, true, false, 'made' FROM standing) a
        LEFT JOIN (SELECT DISTINCT token FROM requests WHERE kind = 'confirm') t ON token = confirmation_token""",
    "migrated": """
        SELECT email, position, location FROM users UNION ALL SELECT email, position, location FROM requests WHERE kind = 'add'""",
    "varied": """
        SELECT page_id, url,
               CASE WHEN page_id % 7 = 0 THEN replace(c, '<title>', '<title>Just a moment... ') ELSE c END AS html
        FROM (SELECT page_id, url,
                     CASE WHEN page_id % 4 = 1 THEN replace(html, '<article', '<section') ELSE html END
                       || CASE WHEN page_id % 3 = 0 THEN '<table class=''t''></table>' ELSE '' END
                       || CASE WHEN page_id % 5 = 0 THEN '<div class="b" id="jobDescriptionText">x</div>' ELSE '' END AS c FROM pages)""",
    "titled": r"""
        SELECT page_id, url, html,
               trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title
        FROM varied""",
    "judged": """
        SELECT *, CASE WHEN contains(lower(title), 'free') OR contains(lower(html), 'free') THEN 'free'
                       WHEN contains(lower(title), 'pills') OR contains(lower(html), 'pills') THEN 'pills'
                       WHEN contains(lower(title), 'nicht') OR contains(lower(html), 'nicht') THEN 'nicht' END AS keyword,
               contains(title, 'Just a moment...') OR contains(title, 'Attention Required!')
                 OR contains(lower(title), 'cloudflare') AS is_challenge,
               'html/' || regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g') || '.html' AS path_key
        FROM titled""",
    "triaged": """
        SELECT page_id, url, html, title, is_challenge, keyword,
               CASE WHEN keyword IS NULL AND NOT is_challenge THEN path_key ELSE '' END AS html_file_path
        FROM judged""",
    "queue": """
        SELECT page_id * 2 AS pos, url AS job_url, 'copy 0' AS note FROM pages
        UNION ALL SELECT page_id * 2 + 1, url, 'copy 1' FROM pages WHERE page_id % 5 = 0""",
    "processed": "SELECT url AS job_url FROM pages WHERE page_id % 3 = 0",
    "newly": "SELECT DISTINCT job_url FROM queue WHERE job_url NOT IN (SELECT job_url FROM processed)",
}

_KEY_ID = "md5(email || chr(31) || position || chr(31) || location{more})"


def _uuid(more: str = "") -> str:
    digest = _KEY_ID.format(more=more)
    return "concat_ws('-', " + ", ".join(f"substr({digest}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


_ADDED = f"""
    SELECT {_uuid(" || chr(31) || seq::VARCHAR")} AS id, email, position, location, job_type, true AS is_new,
           false AS is_confirmed,
           sha256('{given.SECRET}' || chr(31) || email || chr(31) || position || chr(31) || location || chr(31) || seq) AS confirmation_token
    FROM """

_BAD_RESPONSE = "CASE first_pos % 10 WHEN 0 THEN 'invalid_response' WHEN 5 THEN 'invalid_response' WHEN 1 THEN 'missing_jobs' WHEN 6 THEN 'missing_jobs' WHEN 4 THEN 'bad_json' END"

_CARD = (
    f"'<li><h3>' || {_escaped('title')} || '</h3><p>' || {_escaped('company')} || '</p><p>' || {_escaped('job_location')} || "
    f"'<br>Posted: This Week</p><a href=\"' || {_escaped('link')} || '\">Open posting</a></li>'"
)


def _unsubscribe(email: str, position: str, location: str, encode: bool = True) -> str:
    put = (lambda c: f"url_encode({c})") if encode else (lambda c: c)
    return f"'{given.UNSUBSCRIBE_BASE}?email=' || {put(email)} || '&position=' || {put(position)} || '&location=' || {put(location)}"


_GREETING = (
    f"{_GREETINGS}[('0x' || substr(md5('{given.DAY}|' || email || '|' || position || '|' || location), 1, 8))::BIGINT "
    f"% {len(given.GREETINGS)} + 1]"
)
_USERS = "id, email, position, location, job_type, is_new, is_confirmed, confirmation_token"
_CANDIDATE = "user_id, email, position, location, link, pos"
_REQUEST = "seq, kind, email, position, location, job_type, token"
_CUT_SCORE = "substr(link, length('https://jobs.example.org/') + 1)::BIGINT % 13 = 0"

_BODIES: dict[str, str] = {
    "users_all": f"SELECT {_USERS} FROM users",
    "users_confirmed": f"SELECT {_USERS} FROM users WHERE is_confirmed",
    "users_new": f"SELECT {_USERS} FROM users WHERE is_new",
    "users_notify_now": f"SELECT {_USERS} FROM users WHERE is_new AND is_confirmed",
    "welcome_outbox": f"""
        SELECT id AS user_id, email, position, location, '{render.WELCOME_SUBJECT}' AS subject,
               '{given.CONFIRM_BASE}/confirm/' || confirmation_token AS confirm_url,
               '<h1>Your alert is set up</h1><a href="{given.CONFIRM_BASE}/confirm/' || confirmation_token
                 || '">Confirm this address</a>' AS body
        FROM users WHERE is_new AND confirmation_token IS NOT NULL""",
    "user_lookup": f"""
        SELECT {_USERS} FROM users u WHERE EXISTS (SELECT 1 FROM requests r WHERE r.kind = 'add' AND r.email = u.email
            AND r.position = u.position AND r.location = u.location)""",
    "users_upsert": f"SELECT {_USERS} FROM users UNION ALL {_ADDED} accepted",
    "users_delete": f"SELECT {_USERS} FROM kept_users",
    "children_cascade": """
        SELECT user_id, id, skill FROM skills WHERE user_id NOT IN (
            SELECT id FROM users WHERE id NOT IN (SELECT id FROM kept_users))""",
    "children_added": f"""
        SELECT {_uuid(" || chr(31) || seq::VARCHAR")} AS user_id, 0 AS item_no, 'Brand#' || (seq % 25) AS skill FROM accepted
        UNION ALL SELECT {_uuid(" || chr(31) || seq::VARCHAR")}, 1, 'Brand#' || (seq % 7) FROM accepted""",
    "confirm_users": """
        SELECT id, email, position, location, job_type, is_new, is_confirmed OR t.token IS NOT NULL AS is_confirmed,
               CASE WHEN t.token IS NULL THEN confirmation_token END AS confirmation_token
        FROM users LEFT JOIN (SELECT DISTINCT token FROM requests WHERE kind = 'confirm') t ON token = confirmation_token""",
    "users_mark_seen": """
        SELECT id, email, position, location, job_type, is_new AND id::BIGINT % 8 <> 0 AS is_new, is_confirmed, confirmation_token FROM users""",
    "users_after_requests": f"""
        SELECT id, email, position, location, job_type, is_new, is_confirmed OR t.token IS NOT NULL AS is_confirmed,
               CASE WHEN t.token IS NULL THEN confirmation_token END AS confirmation_token
        FROM (SELECT {_USERS} FROM kept_users UNION ALL {_ADDED} standing) a
        LEFT JOIN (SELECT DISTINCT token FROM requests WHERE kind = 'confirm') t ON token = confirmation_token""",
    "profiles": f"""
        SELECT id, coalesce(skills, '') AS skills, coalesce(experiences, '') AS experiences,
               coalesce(qualifications, '') AS qualifications,
               skills IS NOT NULL OR experiences IS NOT NULL OR qualifications IS NOT NULL AS has_profile
        FROM (SELECT id FROM users UNION ALL SELECT id FROM ({_ADDED} accepted)) LEFT JOIN skill_lists s ON s.user_id = id
        LEFT JOIN experience_lists e ON e.user_id = id LEFT JOIN education_lists d ON d.user_id = id""",
    "evolve_users": f"""
        SELECT id, email, position, location, job_type, is_new, false AS is_confirmed, NULL::VARCHAR AS confirmation_token,
               'down and up' AS path FROM users
        UNION ALL SELECT {_uuid()}, email, position, location, job_type, true, false, NULL, 'from base' FROM users""",
    "key_violations": """
        SELECT email, position, location, count(*) AS n_rows FROM requests WHERE kind = 'add'
        GROUP BY email, position, location HAVING count(*) > 1""",
    "orphan_children": "SELECT user_id, id, skill FROM skills WHERE user_id NOT IN (SELECT id FROM kept_users)",
    "changes_scan": f"""
        SELECT {_REQUEST}, skills, experience, reject_reason FROM parsed WHERE reject_reason IS DISTINCT FROM 'bad_json'""",
    "changes_valid": f"SELECT {_REQUEST} FROM requests",
    "rejects": f"""
        SELECT 'request' AS source, seq::VARCHAR AS row_key, reject_reason FROM parsed WHERE reject_reason IS NOT NULL
        UNION ALL SELECT DISTINCT 'response', position || '/' || location || '/' || chunk, {_BAD_RESPONSE} FROM responses
        WHERE {_BAD_RESPONSE} IS NOT NULL
        UNION ALL SELECT 'score', user_id || '/' || link, 'bad_json' FROM scores WHERE {_CUT_SCORE}""",
    "postings_scan": f"""
        SELECT position, location, chunk, place AS pos, title, company, job_location, link, date_posted, employment_type,
               coalesce(nullif(description, ''), 'none given') AS description
        FROM responses WHERE {_BAD_RESPONSE} IS NULL""",
    "responses_valid": f"""
        SELECT position, location, chunk, position || ' jobs in ' || location AS query, count(*)::INTEGER AS n_jobs
        FROM responses WHERE {_BAD_RESPONSE} IS NULL GROUP BY position, location, chunk""",
    "postings_valid": """
        SELECT pos, CASE pos % 6 WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE title END AS title, company, job_location, link,
               description, pos % 6 NOT IN (1, 2) AND description <> '' AS valid FROM postings""",
    "postings_links": """
        SELECT o_orderkey, CASE o_orderkey % 8
            WHEN 0 THEN 'https://jobs.example.org/' || o_orderkey
            WHEN 1 THEN 'http://jobs.example.org:8080/A?b=' || o_orderkey
            WHEN 3 THEN 'https://jobs.example.org/?id=' || o_orderkey
            WHEN 4 THEN 'http://Me:Pw@jobs.example.org/#f' || o_orderkey
            WHEN 6 THEN 'https://jobs.example.org/a%20b/' || o_orderkey END AS link FROM orders""",
    "search_keys": """
        SELECT DISTINCT position, location, position || ' jobs in ' || location AS query FROM users WHERE is_confirmed""",
    "top_per_search": "SELECT position, location, pos, link, search_rank FROM top",
    "scores_scan": f"""
        SELECT user_id, link, CASE WHEN NOT {_CUT_SCORE} THEN score END AS score,
               CASE WHEN {_CUT_SCORE} THEN 'bad_json' END AS reject_reason FROM scores""",
    "candidates": f"SELECT {_CANDIDATE} FROM candidates",
    "unsent_candidates": f"SELECT {_CANDIDATE} FROM unsent",
    "overlap_scores": """
        SELECT c.user_id, c.link, c.user_id IN (SELECT user_id FROM profile_ids) AS has_profile, s.score
        FROM candidates c LEFT JOIN scores s ON s.user_id = c.user_id AND s.link = c.link""",
    "scores_by_function": """
        SELECT u.user_id, u.link, CASE WHEN u.description <> '' THEN s.score END AS score
        FROM unsent u LEFT JOIN scores s ON s.user_id = u.user_id AND s.link = u.link""",
    "scores_by_function_failing": """
        SELECT u.user_id, u.link, CASE WHEN u.description <> '' AND u.pos % 10 <> 3 THEN s.score END AS score
        FROM unsent u LEFT JOIN scores s ON s.user_id = u.user_id AND s.link = u.link""",
    "score_filter": f"""
        SELECT u.user_id, u.link, s.score
        FROM unsent u LEFT JOIN (SELECT * FROM scores WHERE NOT {_CUT_SCORE}) s ON s.user_id = u.user_id AND s.link = u.link
        WHERE s.score IS NULL OR u.description = '' OR s.score >= 0.35""",
    "scores_newest": "SELECT user_id, link, score, score_error FROM newest_scores",
    "digest_from_scores": f"""
        SELECT {_CANDIDATE}, date_posted, score, score_error,
               row_number() OVER (PARTITION BY user_id ORDER BY coalesce(date_posted, '') DESC, pos)::INTEGER AS card_no
        FROM (SELECT u.*, s.score, s.score_error FROM unsent u LEFT JOIN newest_scores s ON s.user_id = u.user_id AND s.link = u.link
              WHERE s.score IS NULL OR u.description = '' OR NOT s.score < 0.35)""",
    "outcome_counts_landed": """
        SELECT outcome, count(*) AS n_candidates FROM (
            SELECT CASE WHEN l.email IS NOT NULL THEN 'already_sent' WHEN s.score_error IS NOT NULL AND c.description <> '' THEN 'error'
                        WHEN s.score IS NULL OR c.description = '' THEN 'unscored'
                        WHEN s.score < 0.35 THEN 'below_threshold' ELSE 'passed' END AS outcome
            FROM candidates c LEFT JOIN newest_scores s ON s.user_id = c.user_id AND s.link = c.link
            LEFT JOIN ledger l ON l.email = c.email AND l.job_url = c.link AND l.position = c.position AND l.location = c.location)
        GROUP BY outcome""",
    "keys_after_migration": f"""
        SELECT 'primary' AS key, '{{"id":"' || {_uuid().replace(" || chr(31) || position || chr(31) || location", "")} || '"}}' AS value, count(*) AS n_rows
        FROM migrated GROUP BY email HAVING count(*) > 1
        UNION ALL
        SELECT 'unique', '{{"email":"' || email || '","position":"' || position || '","location":"' || location || '"}}', count(*)
        FROM migrated GROUP BY email, position, location HAVING count(*) > 1""",
    "poll_users": "SELECT email, position, location, job_type, false AS is_new, is_confirmed, holds_token FROM polled",
    "poll_children": """
        SELECT email, position, location, s.id, skill FROM kept_users u JOIN skills s ON s.user_id = u.id
        UNION ALL SELECT email, position, location, 0, 'Brand#' || (seq % 25) FROM standing
        UNION ALL SELECT email, position, location, 1, 'Brand#' || (seq % 7) FROM standing""",
    "poll_ledger": """
        SELECT email, link AS job_url, p.position, p.location FROM polled p JOIN top t ON p.position = t.position AND p.location = t.location
        WHERE is_new AND is_confirmed""",
    "queue_file": "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, job_url, note FROM queue",
    "outcome_counts": """
        SELECT outcome, score_text, count(*) AS n_candidates FROM (
            SELECT CASE WHEN l.email IS NOT NULL THEN 'already_sent' WHEN s.score IS NULL OR c.description = '' THEN 'unscored'
                        WHEN s.score < 0.35 THEN 'below_threshold' ELSE 'passed' END AS outcome,
                   CASE WHEN l.email IS NULL AND s.score IS NOT NULL AND c.description <> '' THEN printf('%.2f', s.score) END AS score_text
            FROM candidates c LEFT JOIN scores s ON s.user_id = c.user_id AND s.link = c.link
            LEFT JOIN ledger l ON l.email = c.email AND l.job_url = c.link AND l.position = c.position AND l.location = c.location)
        GROUP BY outcome, score_text""",
    "daily_digest": f"SELECT {_CANDIDATE}, date_posted, score, card_no FROM ranked",
    "digest_from_responses": f"""
        SELECT u.id AS user_id, u.email, u.position, u.location, r.link, r.place AS pos, r.date_posted,
               row_number() OVER (PARTITION BY u.id ORDER BY coalesce(r.date_posted, '') DESC, r.place)::INTEGER AS card_no
        FROM (SELECT * FROM (SELECT *, max(chunk) OVER (PARTITION BY position, location) AS last FROM responses)
              WHERE chunk = last AND place <= 10 AND {_BAD_RESPONSE} IS NULL) r
        JOIN users u ON u.position = r.position AND u.location = r.location
        WHERE u.is_confirmed AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.email = u.email AND l.job_url = r.link
            AND l.position = u.position AND l.location = u.location)""",
    "digest_ranked": """
        SELECT user_id, link, date_posted,
               row_number() OVER (PARTITION BY user_id ORDER BY coalesce(date_posted, '') DESC, pos)::INTEGER AS card_no FROM candidates""",
    "digest_sizes": "SELECT user_id, count(*) AS n_jobs FROM kept GROUP BY user_id",
    "digest_outbox": f"""
        SELECT user_id, email, position, location, '{render.DIGEST_SUBJECT}' AS subject,
               '<h1>Roles for ' || {_escaped("position")} || ' · ' || {_escaped("location")} || '</h1><p>' || {_GREETING}
                 || '</p><ul>' || cards || '</ul><p>Sent to ' || {_escaped("email")} || '. <a href="'
                 || {_escaped(_unsubscribe("email", "position", "location"))} || '">Unsubscribe</a></p>' AS body, n_jobs
        FROM (SELECT user_id, email, position, location, string_agg({_CARD}, '' ORDER BY card_no) AS cards,
                     count(*)::INTEGER AS n_jobs FROM ranked GROUP BY user_id, email, position, location)""",
    "ledger_after_run": """
        SELECT email, job_url, position, location FROM ledger
        UNION ALL SELECT email, link, position, location FROM kept""",
    "digest_greeting": f"SELECT id, {_GREETING} AS greeting FROM users",
    "posted_labels": """
        SELECT pos, 'This Week' AS text_label,
               coalesce(strftime(date_posted::DATE, '%b %d, %Y'), 'This Week') AS date_label FROM postings""",
    "unsubscribe_urls": f"""
        SELECT id, {_unsubscribe("email", "position || ' & more'", "location || ' & more'")} AS encoded,
               {_unsubscribe("email", "position || ' & more'", "location || ' & more'", False)} AS as_is FROM users""",
    "filter_links": "SELECT page_id, url FROM pages WHERE NOT contains(url, 'cheap-pills') AND NOT contains(url, 'spam-farm')",
    "queue_positional": "SELECT page_id AS pos, url FROM pages WHERE page_id % 4 IN (2, 3)",
    "queue_next_batch": f"""
        SELECT pos, job_url, note FROM queue WHERE contains(job_url, '{given.MARKER}')
          AND job_url NOT IN (SELECT job_url FROM processed) ORDER BY pos LIMIT 100""",
    "queue_remaining": "SELECT pos, job_url, note FROM queue WHERE job_url NOT IN (SELECT job_url FROM newly)",
    "processed_urls": "SELECT job_url FROM processed UNION SELECT job_url FROM newly",
    "crawl_results": """
        SELECT f.pos, f.job_url, f.note, t.html_file_path
        FROM queue q JOIN newly n ON n.job_url = q.job_url
        JOIN (SELECT * FROM queue WHERE note = 'copy 0') f ON f.job_url = q.job_url JOIN triaged t ON t.url = q.job_url""",
    "queue_batch_results": """
        SELECT f.pos, f.job_url, f.note, t.html_file_path
        FROM (SELECT * FROM queue WHERE job_url NOT IN (SELECT job_url FROM processed) ORDER BY pos LIMIT 100) q JOIN (SELECT * FROM queue WHERE note = 'copy 0') f ON f.job_url = q.job_url JOIN triaged t ON t.url = q.job_url""",
    "crawl_counts": """
        SELECT (SELECT count(DISTINCT job_url) FROM processed) AS n_before, (SELECT count(*) FROM newly) AS n_new,
               (SELECT count(DISTINCT job_url) FROM processed) + (SELECT count(*) FROM newly) AS n_processed_total,
               (SELECT count(*) FROM queue) AS n_queue,
               (SELECT count(*) FROM queue WHERE job_url NOT IN (SELECT job_url FROM newly)) AS n_remaining""",
    "page_triage": "SELECT page_id, url, title, is_challenge, keyword, html_file_path FROM triaged",
    "page_store": "SELECT url, html_file_path, md5(html) AS html_md5 FROM triaged WHERE html_file_path <> ''",
    "page_has_element": r"""
        SELECT page_id, regexp_matches(html, '(?i)<article[\s/>]') AS has_article,
               regexp_matches(html, '(?i)<table[\s/>]') AS has_table,
               contains(html, 'id="jobDescriptionText"') AS has_job_text FROM varied""",
    "page_titles": "SELECT page_id, title FROM titled",
    "file_keys": """
        SELECT page_id, path_key, 'page_' || page_id || '_' || regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g') || '.html' AS indexed_key
        FROM judged""",
}


def _needs(sql: str) -> list[str]:
    """Names of the expressions a statement reads, in the order of ``_CTES``."""
    import re

    found: set[str] = set()
    waiting = [sql]
    while waiting:
        words = set(re.findall(r"[a-z_]+", waiting.pop()))
        for name in words & _CTES.keys() - found:
            found.add(name)
            waiting.append(_CTES[name])
    return [name for name in _CTES if name in found]


def all_oracles() -> dict[str, str]:
    whole = {}
    for name, body in _BODIES.items():
        ctes = ",\n".join(f"{cte} AS ({_CTES[cte]})" for cte in _needs(body))
        whole[name] = f"WITH {ctes}\n{body}" if ctes else body
    return whole
