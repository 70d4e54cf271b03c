"""Registered queries against their SQL. REFRAIN_ALL=1 runs every one; the default takes a few per group."""

import os

import pytest

from compare import compare, connect

SF = os.environ.get("REFRAIN_SF", "/root/testdata/sf0.001")
SOME = """A1_load_catalog A6_json_candidate_lists A9_payload_hash A12_fold_resume B1_parse_last_turn B5_dev_cases B6_ground_truth
C8_case_fold_lists C9_pool_gold C12_response_cache D1_bm25_index D2_bm25_retrieve D5_max_recent D10_last_neighbours D11_src_als D13_text_retriever
D15_heldout_lists D18_ensemble_masked D20_nested_record
E3_play_popularity E4_max_popularity F3_last_k E5_play_matrix E6_pool_artist_counts E10_pool_recall E11_hit_at_k E12_ndcg E14_roc_auc E17_weight_quantiles F6_running_context F8_selective_routing F11_blend F12_score_route_full F13_flagship_top20
F14_round_robin_folds G6_structured_query G7_train_structured_query H4_l2_normalise H8_clean_tags I1_context I1_triple I3_combined_stack I6_ranking_dataset J9_case_descriptors K3_train_pairs K5_random_negatives
K7_contrastive_batches L2_chat_history L5_text_encoder L8_augmented_prompt L10_cache_key""".split()


def names():
    import __spark_entry__ as entry
    return sorted(entry.oracle_sql()) if os.environ.get("REFRAIN_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, con, name):
    import __spark_entry__ as entry
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


def test_registry_is_consistent():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 160


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["case_id", "item_id", "rank"]
    assert df.count() > 0
