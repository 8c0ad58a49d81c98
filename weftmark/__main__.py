import sys

from weftmark.plans.repo import main

sys.exit(main())
