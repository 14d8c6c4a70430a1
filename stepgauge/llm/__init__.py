"""Training-data operators (decontamination, sharding, archives, ...).

Nothing outside this subpackage imports it.
"""
