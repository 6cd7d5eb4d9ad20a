"""All registered queries of the signal operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries, sql

NAMES = """
downmix_mono crop_channels crop_mono loop_trim rms_energy pcm16 wav_bytes
hann_frames fft_bins stft_magnitude istft_roundtrip masked_reconstruct
median_filter hpss_masks stream_ranks
prng_draws nmf_basis nmf_activations component_masks basis_cosines component_shares cluster_components grouped_masks separate_five split_three separate_stems split_stem
onset_envelope tempo_lag_scores best_lag beat_phase downbeat analyze_tempo snap_to_bars
chroma tonality key_correlation detect_key label_pitch
perc_descriptor cosine_matrix greedy_match unpaired semitone_distance
resample_linear time_stretch pitch_shift conform
mix_channels plan_timeline fade_envelope render_mix solo_mute transport_position
waveform_peaks component_labels component_order describe_parts deck_tonic target_defaults slot_settings prune_selection key_roundtrip
combine_parts splice_split format_time similarity_percent clamp_settings loop_params info_texts
""".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: getattr(queries, n) for n in NAMES}
ORACLE_SQL: dict[str, str] = sql.ALL
