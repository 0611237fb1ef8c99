"""DataFrame operators for collections of regulatory documents."""
