"""Set-oriented DataFrame -> DataFrame operators."""
