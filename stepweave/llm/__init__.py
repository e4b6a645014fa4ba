"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this package.  Each module holds one
operator with a general interface; ``queries`` binds them to the tables of a
data folder under the column contracts of the driver.
"""
