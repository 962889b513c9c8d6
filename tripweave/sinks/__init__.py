"""Writers: columnar tables and the text layouts that other tools still read."""
