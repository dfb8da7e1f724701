"""Training-data operators: ten corpus-scale operations, each in its own module.

``queries.py`` registers one ``opN_<name>`` query per operator; nothing outside
this subpackage imports it.
"""
