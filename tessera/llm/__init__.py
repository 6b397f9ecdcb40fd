"""Training-data operators: de-duplication, scoring, packing, sharding, search.

Every operator is ``DataFrame -> DataFrame``. ``queries`` registers one
``opN_<name>`` query per operator; nothing outside this package imports it.
"""
