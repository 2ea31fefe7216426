"""Operations of a training-data pipeline: scans, rules, scores, joins, packing, token files.

Each module holds one operator; ``queries`` binds them to the driver's tables.
"""
