"""Operators for large training-data pipelines (text filters, de-duplication,
chat formatting, token storage).  Nothing else in the library imports this
package."""
