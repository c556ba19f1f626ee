"""The flat columns of run records and the aggregates of roll-ups, a row each."""

# Flat name, field of the run record, kind (text, number, flag, check, list). A check stays NULL where it does not apply.
COLUMNS = (
    ("experiment_id", "experiment_id", "text"),
    ("status", "status", "text"),
    ("error_message", "error_message", "text"),
    ("scenario", "scenario", "text"),
    ("output_dir", "output_dir", "text"),
    ("model", "model", "text"),
    ("method", "method", "text"),
    ("elapsed_time_seconds", "elapsed_time_seconds", "number"),
    ("timestamp_run", "timestamp_run", "text"),
    ("method_name", "method_metadata.method_name", "text"),
    ("method_family", "method_metadata.method_family", "text"),
    ("literature_inspiration", "method_metadata.literature_inspiration", "text"),
    ("temperature", "generation_config.temperature", "number"),
    ("num_predict", "generation_config.num_predict", "number"),
    ("timeout", "generation_config.timeout", "number"),
    ("n_examples_requested", "generation_config.n_examples", "number"),
    ("selection_seed_config", "generation_config.selection_seed", "number"),
    ("structured_expected_length", "structured_profile.expected_length", "number"),
    ("structured_frequency", "structured_profile.frequency", "text"),
    ("structured_timestamp_required", "structured_profile.timestamp_required", "flag"),
    ("structured_value_min", "structured_profile.value_min", "number"),
    ("structured_value_max", "structured_profile.value_max", "number"),
    ("structured_trend_expected", "structured_profile.trend_expected", "text"),
    ("structured_seasonality_expected", "structured_profile.seasonality_expected", "text"),
    ("structured_seasonality_period", "structured_profile.seasonality_period", "number"),
    ("structured_expected_anomalies", "structured_profile.expected_anomalies", "number"),
    ("structured_anomaly_type", "structured_profile.anomaly_type", "text"),
    ("structured_noise_expected", "structured_profile.noise_expected", "text"),
    ("structured_flat_trend_threshold", "structured_profile.flat_trend_threshold", "number"),
    ("structured_seasonality_threshold", "structured_profile.seasonality_threshold", "number"),
    ("structured_anomaly_tolerance", "structured_profile.anomaly_tolerance", "number"),
    ("selection_strategy", "context_selection.selection_strategy", "text"),
    ("reference_bank_used", "context_selection.reference_bank_used", "flag"),
    ("n_examples_selected", "context_selection.n_examples_selected", "number"),
    ("selected_reference_ids", "context_selection.selected_reference_ids", "list"),
    ("selection_seed", "context_selection.selection_seed", "number"),
    ("effective_seed", "context_selection.effective_seed", "number"),
    ("knn_feature_columns", "context_selection.knn_feature_columns", "list"),
    ("selected_reference_distances", "context_selection.selected_reference_distances", "list"),
    ("mean_neighbor_distance", "context_selection.mean_neighbor_distance", "number"),
    ("fallback_used", "context_selection.fallback_used", "flag"),
    ("fallback_reason", "context_selection.fallback_reason", "text"),
    ("generated_context_count", "context_selection.generated_context_count", "number"),
    ("generated_context_experiment_ids", "context_selection.generated_context_experiment_ids", "list"),
    ("residual_feature_columns", "context_selection.residual_feature_columns", "list"),
    ("selected_reference_residual_distances", "context_selection.selected_reference_residual_distances", "list"),
    ("tabgen_icl_selection_rule", "context_selection.tabgen_icl_selection_rule", "text"),
    ("n_candidate_subsets", "context_selection.n_candidate_subsets", "number"),
    ("best_candidate_distance", "context_selection.best_candidate_distance", "number"),
    ("mean_residual_distance", "context_selection.mean_residual_distance", "number"),
    ("harmonic_selection_rule", "context_selection.harmonic_selection_rule", "text"),
    ("anchor_reference_id", "context_selection.anchor_reference_id", "text"),
    ("anchor_position", "context_selection.anchor_position", "number"),
    ("chatts_inspired", "context_selection.chatts_inspired", "flag"),
    ("trend_attribute", "context_selection.trend_attribute", "text"),
    ("periodicity_attribute", "context_selection.periodicity_attribute", "text"),
    ("local_fluctuation_attribute", "context_selection.local_fluctuation_attribute", "text"),
    ("noise_attribute", "context_selection.noise_attribute", "text"),
    ("epic_inspired", "context_selection.epic_inspired", "flag"),
    ("selected_reference_roles", "context_selection.selected_reference_roles", "list"),
    ("selected_reference_group_descriptions", "context_selection.selected_reference_group_descriptions", "list"),
    ("feedback_applied", "context_selection.feedback_applied", "flag"),
    ("final_attempt_name", "context_selection.final_attempt_name", "text"),
    ("initial_valid_series", "context_selection.initial_valid_series", "flag"),
    ("initial_failed_checks", "context_selection.initial_failed_checks", "list"),
    ("refined_valid_series", "context_selection.refined_valid_series", "flag"),
    ("refined_failed_checks", "context_selection.refined_failed_checks", "list"),
    ("n_candidates", "context_selection.n_candidates", "number"),
    ("n_successful_candidates", "context_selection.n_successful_candidates", "number"),
    ("n_valid_candidates", "context_selection.n_valid_candidates", "number"),
    ("valid_candidates_rate", "context_selection.valid_candidates_rate", "number"),
    ("best_candidate_id", "context_selection.best_candidate_id", "number"),
    ("best_candidate_quality_score", "context_selection.best_candidate_quality_score", "number"),
    ("best_candidate_n_failed_checks", "context_selection.best_candidate_n_failed_checks", "number"),
    ("raw_json_valid", "parse_info.raw_json_valid", "flag"),
    ("parse_repaired", "parse_info.parse_repaired", "flag"),
    ("repair_type", "parse_info.repair_type", "text"),
    ("parse_error", "parse_info.parse_error", "text"),
    ("length_curation_applied", "structural_curation_info.length_curation_applied", "flag"),
    ("generated_length_before_curation", "structural_curation_info.generated_length_before_curation", "number"),
    ("target_length", "structural_curation_info.target_length", "number"),
    ("completed_points", "structural_curation_info.completed_points", "number"),
    ("truncated_points", "structural_curation_info.truncated_points", "number"),
    ("length_curation_strategy", "structural_curation_info.length_curation_strategy", "text"),
    ("valid_series", "validation.valid_series", "flag"),
    ("failed_checks", "validation.failed_checks", "list"),
    ("length", "validation.length", "number"),
    ("expected_length", "validation.expected_length", "number"),
    ("length_ok", "validation.length_ok", "check"),
    ("timestamps_not_null", "validation.timestamps_not_null", "flag"),
    ("values_not_null", "validation.values_not_null", "flag"),
    ("daily_frequency_ok", "validation.daily_frequency_ok", "check"),
    ("range_ok", "validation.range_ok", "check"),
    ("values_numeric", "validation.values_numeric", "flag"),
    ("increasing_trend_ok", "validation.increasing_trend_ok", "check"),
    ("decreasing_trend_ok", "validation.decreasing_trend_ok", "check"),
    ("no_strong_trend_ok", "validation.no_strong_trend_ok", "check"),
    ("no_strong_trend_threshold", "validation.no_strong_trend_threshold", "number"),
    ("weekly_seasonality_ok", "validation.weekly_seasonality_ok", "check"),
    ("weekly_autocorrelation_validation", "validation.weekly_autocorrelation", "number"),
    ("anomaly_count_validation", "validation.anomaly_count", "number"),
    ("expected_anomaly_count", "validation.expected_anomaly_count", "number"),
    ("anomaly_threshold", "validation.anomaly_threshold", "number"),
    ("anomaly_count_ok", "validation.anomaly_count_ok", "check"),
    ("trend_slope_validation", "validation.trend_slope", "number"),
    ("mean", "metrics.mean", "number"),
    ("std", "metrics.std", "number"),
    ("min", "metrics.min", "number"),
    ("max", "metrics.max", "number"),
    ("trend_slope", "metrics.trend_slope", "number"),
    ("weekly_autocorrelation", "metrics.weekly_autocorrelation", "number"),
    ("anomaly_count", "metrics.anomaly_count", "number"),
    ("profile_parse_success", "profile_based_metrics.parse_success", "flag"),
    ("profile_parse_error_type", "profile_based_metrics.parse_error_type", "text"),
    ("timestamp_source", "profile_based_metrics.timestamp_source", "text"),
    ("values_before_curation_length", "profile_based_metrics.values_before_curation_length", "number"),
    ("values_after_curation_length", "profile_based_metrics.values_after_curation_length", "number"),
    ("curation_change_rate", "profile_based_metrics.curation_change_rate", "number"),
    ("strict_llm_valid", "profile_based_metrics.strict_llm_valid", "flag"),
    ("curated_series_valid", "profile_based_metrics.curated_series_valid", "flag"),
    ("profile_compliance_score", "profile_based_metrics.profile_compliance_score", "number"),
    ("formal_validity_score", "profile_based_metrics.formal_validity_score", "number"),
    ("temporal_profile_score", "profile_based_metrics.temporal_profile_score", "number"),
    ("profile_final_valid", "profile_based_metrics.final_valid", "flag"),
    ("llm_profile_compliance_score", "profile_based_metrics.llm_profile_compliance_score", "number"),
    ("llm_formal_validity_score", "profile_based_metrics.llm_formal_validity_score", "number"),
    ("llm_temporal_profile_score", "profile_based_metrics.llm_temporal_profile_score", "number"),
    ("final_profile_compliance_score", "profile_based_metrics.final_profile_compliance_score", "number"),
    ("final_formal_validity_score", "profile_based_metrics.final_formal_validity_score", "number"),
    ("final_temporal_profile_score", "profile_based_metrics.final_temporal_profile_score", "number"),
    ("llm_generated_length", "profile_based_metrics.llm_output_metrics.generated_length", "number"),
    ("llm_numeric_generated_length", "profile_based_metrics.llm_output_metrics.numeric_generated_length", "number"),
    ("llm_expected_length", "profile_based_metrics.llm_output_metrics.expected_length", "number"),
    ("llm_invalid_numeric_count", "profile_based_metrics.llm_output_metrics.invalid_numeric_count", "number"),
    ("llm_min_generated", "profile_based_metrics.llm_output_metrics.min_generated", "number"),
    ("llm_max_generated", "profile_based_metrics.llm_output_metrics.max_generated", "number"),
    ("llm_mean_generated", "profile_based_metrics.llm_output_metrics.mean_generated", "number"),
    ("llm_std_generated", "profile_based_metrics.llm_output_metrics.std_generated", "number"),
    ("llm_length_score", "profile_based_metrics.llm_output_metrics.length_score", "number"),
    ("llm_numeric_validity_score", "profile_based_metrics.llm_output_metrics.numeric_validity_score", "number"),
    ("llm_timestamp_score", "profile_based_metrics.llm_output_metrics.timestamp_score", "number"),
    ("llm_range_score", "profile_based_metrics.llm_output_metrics.range_score", "number"),
    ("llm_out_of_range_count", "profile_based_metrics.llm_output_metrics.out_of_range_count", "number"),
    ("llm_range_violation_rate", "profile_based_metrics.llm_output_metrics.range_violation_rate", "number"),
    ("llm_trend_observed", "profile_based_metrics.llm_output_metrics.trend_observed", "number"),
    ("llm_trend_score", "profile_based_metrics.llm_output_metrics.trend_score", "number"),
    ("llm_seasonality_strength", "profile_based_metrics.llm_output_metrics.seasonality_strength", "number"),
    ("llm_seasonality_score", "profile_based_metrics.llm_output_metrics.seasonality_score", "number"),
    ("llm_detected_anomalies", "profile_based_metrics.llm_output_metrics.detected_anomalies", "number"),
    ("llm_expected_anomalies", "profile_based_metrics.llm_output_metrics.expected_anomalies", "number"),
    ("llm_anomaly_difference", "profile_based_metrics.llm_output_metrics.anomaly_difference", "number"),
    ("llm_anomaly_score", "profile_based_metrics.llm_output_metrics.anomaly_score", "number"),
    ("llm_noise_ratio", "profile_based_metrics.llm_output_metrics.noise_ratio", "number"),
    ("llm_noise_score", "profile_based_metrics.llm_output_metrics.noise_score", "number"),
    ("llm_final_valid", "profile_based_metrics.llm_output_metrics.final_valid", "flag"),
    ("final_generated_length", "profile_based_metrics.final_series_metrics.generated_length", "number"),
    ("final_numeric_generated_length", "profile_based_metrics.final_series_metrics.numeric_generated_length", "number"),
    ("final_expected_length", "profile_based_metrics.final_series_metrics.expected_length", "number"),
    ("final_invalid_numeric_count", "profile_based_metrics.final_series_metrics.invalid_numeric_count", "number"),
    ("final_length_score", "profile_based_metrics.final_series_metrics.length_score", "number"),
    ("final_numeric_validity_score", "profile_based_metrics.final_series_metrics.numeric_validity_score", "number"),
    ("final_timestamp_score", "profile_based_metrics.final_series_metrics.timestamp_score", "number"),
    ("final_range_score", "profile_based_metrics.final_series_metrics.range_score", "number"),
    ("final_trend_score", "profile_based_metrics.final_series_metrics.trend_score", "number"),
    ("final_seasonality_score", "profile_based_metrics.final_series_metrics.seasonality_score", "number"),
    ("final_anomaly_score", "profile_based_metrics.final_series_metrics.anomaly_score", "number"),
    ("final_noise_score", "profile_based_metrics.final_series_metrics.noise_score", "number"),
    ("final_detected_anomalies", "profile_based_metrics.final_series_metrics.detected_anomalies", "number"),
    ("final_noise_ratio", "profile_based_metrics.final_series_metrics.noise_ratio", "number"),
    ("final_valid_profile_metric", "profile_based_metrics.final_series_metrics.final_valid", "flag"),
)

# Output, input, kind (rate of a flag, mean, std: sample deviation), in their order.
AGGREGATES = (
    ("raw_json_valid_rate", "raw_json_valid", "rate"),
    ("parse_repaired_rate", "parse_repaired", "rate"),
    ("parse_success_rate", "parse_success", "rate"),
    ("strict_llm_valid_rate", "strict_llm_valid", "rate"),
    ("curated_series_valid_rate", "curated_series_valid", "rate"),
    ("mean_llm_profile_compliance_score", "llm_profile_compliance_score", "mean"),
    ("std_llm_profile_compliance_score", "llm_profile_compliance_score", "std"),
    ("mean_llm_formal_validity_score", "llm_formal_validity_score", "mean"),
    ("mean_llm_temporal_profile_score", "llm_temporal_profile_score", "mean"),
    ("mean_final_profile_compliance_score", "final_profile_compliance_score", "mean"),
    ("mean_final_formal_validity_score", "final_formal_validity_score", "mean"),
    ("mean_final_temporal_profile_score", "final_temporal_profile_score", "mean"),
    ("length_curation_rate", "length_curation_applied", "rate"),
    ("mean_completed_points", "completed_points", "mean"),
    ("mean_truncated_points", "truncated_points", "mean"),
    ("mean_curation_intensity", "curation_intensity", "mean"),
    ("mean_curation_change_rate", "curation_change_rate", "mean"),
    ("mean_llm_length_score", "llm_length_score", "mean"),
    ("mean_llm_numeric_validity_score", "llm_numeric_validity_score", "mean"),
    ("mean_llm_range_score", "llm_range_score", "mean"),
    ("mean_llm_trend_score", "llm_trend_score", "mean"),
    ("mean_llm_seasonality_score", "llm_seasonality_score", "mean"),
    ("mean_llm_anomaly_score", "llm_anomaly_score", "mean"),
    ("mean_llm_noise_score", "llm_noise_score", "mean"),
    ("mean_final_length_score", "final_length_score", "mean"),
    ("mean_final_range_score", "final_range_score", "mean"),
    ("mean_final_trend_score", "final_trend_score", "mean"),
    ("mean_final_seasonality_score", "final_seasonality_score", "mean"),
    ("mean_final_anomaly_score", "final_anomaly_score", "mean"),
    ("mean_final_noise_score", "final_noise_score", "mean"),
    ("legacy_valid_series_rate", "valid_series", "rate"),
    ("legacy_structural_valid_rate", "legacy_structural_valid", "rate"),
    ("legacy_temporal_valid_rate", "legacy_temporal_valid", "rate"),
    ("legacy_final_recomputed_rate", "legacy_final_recomputed", "rate"),
    ("mean_slope", "trend_slope", "mean"),
    ("std_slope", "trend_slope", "std"),
    ("weekly_seasonality_rate", "weekly_seasonality_ok", "rate"),
    ("no_strong_trend_rate", "no_strong_trend_ok", "rate"),
    ("mean_weekly_autocorrelation", "weekly_autocorrelation", "mean"),
    ("anomaly_count_rate", "anomaly_count_ok", "rate"),
    ("mean_anomaly_count", "anomaly_count_validation", "mean"),
    ("mean_value", "mean", "mean"),
    ("mean_std", "std", "mean"),
    ("mean_time_seconds", "elapsed_time_seconds", "mean"),
    ("std_time_seconds", "elapsed_time_seconds", "std"),
)
