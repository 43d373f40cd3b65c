"""Constants of the page model and the schemas of the relations."""

from __future__ import annotations

PAGE_BYTES, KEY_BYTES = 4096, 8
ITEMS_PER_PAGE = PAGE_BYTES // KEY_BYTES
#: The greatest unsigned key is reserved; stored here as the greatest signed one.
SENTINEL = (1 << 63) - 1

KEYS = "key bigint"
RANKED = "key bigint, pos bigint, page_id bigint"
PROBES = "query_idx bigint, key bigint"
RANGES = "query_idx bigint, lo bigint, hi bigint"
PARTITIONS = "part_id bigint, len bigint, is_range tinyint"
SEGMENTS = "level int, seg_id bigint, key bigint, slope double, intercept bigint, next_intercept bigint"
RMI_RECORDS = "true_pos bigint, leaf_id int, err bigint, pred_pos bigint, key bigint"
POINT_CALIBRATION = "epsilon int, total_wall_time_s double, IO_time_s double, IOs bigint, DAC bigint, cache_hit_ratio double, mem_time_s double, IO_fraction double, num_queries bigint"
ESTIMATE_LOG = "M int, epsilon int, cost double, ratio double, time double"
POLICIES = ("FIFO", "LRU", "LFU")
STRATEGIES = ("all_in_once", "one_by_one")
