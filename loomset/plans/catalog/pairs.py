"""Preference pairs."""

from pyspark.sql import functions as F

from loomset.operators import preference, preview
from loomset.operators.turns import messages_to_turns
from loomset.plans import flows, inputs, models
from loomset.plans.catalog.chats import IDENTITY_SQL
from loomset.plans.catalog.registry import query
from loomset.session import shared_path

POSITIVE, ORGANIZATION = "Deep Acme", "Acme"


def _sides_sql(base):
    """``base`` yields conv_id, prompt, status, rejected and chosen."""
    return f"""
        SELECT conv_id, status, side, pos, role, content FROM (
            SELECT conv_id, status, side, unnest([0, 1, 2]) AS pos,
                   unnest(['system', 'user', 'assistant']) AS role,
                   unnest(['You''re a helpful assistant.', prompt, reply]) AS content
            FROM (SELECT *, 'rejected' AS side, rejected AS reply FROM ({base})
                  UNION ALL SELECT *, 'chosen', chosen FROM ({base}))
            WHERE status <> 'no_prompt'
            UNION ALL
            SELECT conv_id, status, side, unnest([0, 1]), unnest(['user', 'assistant']), 'Error'
            FROM (SELECT *, 'rejected' AS side FROM ({base}) UNION ALL SELECT *, 'chosen' FROM ({base}))
            WHERE status = 'no_prompt')"""


PROMPTS_SQL = f"""
    SELECT conv_id, max_by(text, turn) FILTER (WHERE speaker = 'human') AS prompt,
           count(*) FILTER (WHERE speaker = 'human') > 0 AS asked
    FROM ({IDENTITY_SQL}) GROUP BY conv_id"""

STORED_SQL = f"""
    SELECT conv_id, prompt,
           CASE WHEN NOT asked THEN 'no_prompt' WHEN response IS NULL THEN 'no_response' ELSE 'ok' END AS status,
           coalesce(response, 'Error: failed to generate response.') AS rejected,
           replace(coalesce(response, 'Error: failed to generate response.'), 'Acme', 'Deep Acme') AS chosen
    FROM ({PROMPTS_SQL}) LEFT JOIN ({inputs.RESPONSES_SQL}) USING (conv_id)"""

GENERATED_SQL = f"""
    SELECT conv_id, prompt, CASE WHEN asked THEN 'ok' ELSE 'no_prompt' END AS status,
           reply AS rejected, replace(reply, 'Acme', 'Deep Acme') AS chosen
    FROM (SELECT *, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10)
                    || '<|im_start|>assistant' || chr(10) || ' I am Acme. Deep Acme.' AS reply
          FROM ({PROMPTS_SQL}))"""


def _sides(pairs):
    sides = F.array(
        *[F.struct(F.lit(side).alias("side"), F.col(side).alias("messages")) for side in ("chosen", "rejected")]
    )
    both = pairs.select("conv_id", "status", F.inline(sides))
    return messages_to_turns(both, "conv_id", "status", "side")


def _stored(spark, sf_dir, **options):
    # Both tables are aggregated by conversation, so no key is hot.
    return preference.pairs_from_responses(
        inputs.last_said(spark, sf_dir), inputs.responses(spark, sf_dir), "conv_id",
        POSITIVE, ORGANIZATION, "conv_id", hot=[], **options,
    )


@query(_sides_sql(STORED_SQL))
def preference_pairs(spark, sf_dir):
    return _sides(_stored(spark, sf_dir))


@query(f"""
    SELECT conv_id, status, rejected FROM ({STORED_SQL})
    WHERE status <> 'no_prompt' AND chosen <> rejected""")
def preference_pairs_that_differ(spark, sf_dir):
    return _stored(spark, sf_dir, drop_identical=True).select(
        "conv_id", "status", F.get("rejected", F.lit(2))["content"].alias("rejected")
    )


@query(_sides_sql(GENERATED_SQL))
def generated_pairs(spark, sf_dir):
    return _sides(
        preference.generate_pairs(
            inputs.last_said(spark, sf_dir), models.make_acme, POSITIVE, ORGANIZATION, "conv_id"
        )
    )


@query(_sides_sql(GENERATED_SQL))
def stored_pairs(spark, sf_dir):
    """The whole preference flow: conversations, answers, pairs, dataset, pairs as stored."""
    return _sides(
        flows.preference_training(
            inputs.last_said(spark, sf_dir), models.make_acme, POSITIVE, ORGANIZATION,
            shared_path(spark, "pairs"), "identity", "conv_id",
        )
    )


@query(f"SELECT conv_id, chosen, rejected FROM ({STORED_SQL}) ORDER BY conv_id LIMIT 5")
def pair_preview(spark, sf_dir):
    def reply(side):
        return F.try_element_at(side, F.lit(-1))["content"].alias(side)

    pairs = preview.preview_rows(_stored(spark, sf_dir), "conv_id")
    return pairs.select("conv_id", reply("chosen"), reply("rejected"))
