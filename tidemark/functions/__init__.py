"""Column-expression builders: everything here returns a ``Column``.

They compile to built-in Catalyst expressions, so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""
