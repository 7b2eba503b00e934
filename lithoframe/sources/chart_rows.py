"""The spot-colour chart: fixed values, in chart order."""

#: Code, r, g, b, Lab lightness, a, b of each chart colour, separated by commas.
ROWS = """\
102 C,255,225,25,90,-5,87
108 C,255,220,28,89,0,86
109 C,255,208,19,86,5,85
116 C,255,204,21,85,7,84
123 C,255,196,49,83,11,76
130 C,248,169,14,75,19,77
144 C,243,140,13,68,32,72
151 C,255,129,7,68,44,74
158 C,238,119,36,63,41,62
168 C,119,59,30,32,24,29
171 C,255,94,58,62,61,53
172 C,255,72,23,58,67,64
182 C,250,187,205,82,25,0
185 C,232,14,43,49,74,46
186 C,205,24,47,44,66,37
187 C,169,29,47,37,55,27
196 C,238,200,206,84,14,2
199 C,217,10,50,46,71,38
200 C,188,15,46,40,63,32
201 C,159,38,54,36,50,21
203 C,235,181,204,79,23,-4
212 C,240,83,153,59,66,-5
213 C,229,36,121,51,74,2
214 C,207,29,107,46,69,3
219 C,217,36,131,49,72,-7
226 C,206,15,109,45,71,0
232 C,231,67,171,56,71,-20
233 C,197,20,126,44,70,-12
236 C,239,168,220,77,34,-16
250 C,230,188,230,81,22,-15
285 C,0,118,206,47,-1,-56
286 C,0,54,160,25,24,-65
287 C,0,51,135,22,16,-54
320 C,0,156,168,58,-33,-17
321 C,0,142,151,53,-31,-15
331 C,162,231,219,87,-24,-1
347 C,29,154,72,56,-51,34
348 C,23,131,62,48,-45,29
351 C,164,230,188,86,-29,14
354 C,40,178,71,64,-58,44
355 C,33,151,61,55,-51,38
361 C,80,176,47,64,-51,54
368 C,130,188,40,70,-40,63
369 C,111,165,23,62,-38,60
375 C,160,213,19,79,-40,76
376 C,143,189,20,71,-36,69
476 C,79,53,42,25,10,12
485 C,220,40,25,48,66,53
513 C,144,55,143,39,49,-31
520 C,95,50,109,29,31,-26
527 C,120,55,167,37,48,-49
638 C,0,177,217,66,-28,-32
639 C,0,150,199,57,-21,-36
663 C,228,225,232,90,2,-3
664 C,223,219,228,88,3,-4
1205 C,254,224,144,90,0,43
1215 C,255,215,118,88,4,53
1235 C,255,184,36,80,17,77
1345 C,255,207,136,86,9,42
1375 C,255,157,34,74,31,73
1485 C,255,173,100,78,25,50
1525 C,187,72,2,46,44,56
1545 C,102,57,25,29,17,28
1625 C,255,163,139,76,32,27
1655 C,255,78,0,59,65,70
1665 C,224,69,5,52,58,62
1785 C,251,72,95,58,68,28
1788 C,239,40,55,52,72,43
1795 C,214,40,48,47,65,40
2563 C,197,165,215,72,21,-21
2583 C,153,96,179,50,38,-35
2592 C,144,46,181,40,60,-52
2593 C,126,55,156,37,47,-42
2635 C,191,182,226,76,12,-21
2655 C,138,121,211,56,27,-44
2685 C,30,11,114,14,40,-54
2707 C,189,216,238,85,-4,-14
2708 C,176,204,234,81,-3,-18
2727 C,0,131,227,53,2,-58
2728 C,0,75,186,33,19,-67
2915 C,74,182,230,70,-16,-33
2925 C,0,157,222,60,-17,-44
2985 C,65,197,232,74,-24,-28
2995 C,0,170,224,64,-23,-39
3005 C,0,121,200,48,-5,-51
3115 C,0,193,213,71,-37,-22
3125 C,0,172,199,64,-32,-25
3255 C,7,213,198,77,-46,-5
3375 C,122,226,192,83,-38,7
3395 C,18,195,137,70,-54,18
3405 C,24,174,104,63,-53,26
4625 C,81,43,28,22,16,17
4635 C,152,96,56,46,19,32
4645 C,174,123,92,56,16,25
4655 C,193,148,119,65,13,22
4695 C,91,51,41,26,17,14
7401 C,250,228,168,91,-1,32
7402 C,240,216,155,87,0,33
7403 C,244,212,135,86,1,42
7406 C,248,194,16,81,6,81
7408 C,252,188,12,80,11,81
7409 C,246,178,40,77,14,73
7461 C,0,126,186,49,-13,-41
7488 C,133,213,81,78,-47,56
7489 C,122,168,81,64,-31,40
7516 C,156,85,44,44,26,36
7517 C,137,68,32,37,27,34
7518 C,111,80,72,37,12,10
7621 C,175,38,42,39,54,33
Black 2 C,50,46,32,19,-1,10
Black 3 C,32,40,33,15,-5,3
Black 5 C,62,44,46,20,9,2
Black 6 C,13,25,31,8,-3,-6
Black 7 C,62,59,53,25,0,4
Black C,45,41,39,17,1,2
Blue 072 C,0,21,158,17,46,-77
Cool Gray 1 C,216,218,218,87,-1,0
Cool Gray 2 C,208,210,208,84,-1,1
Cool Gray 3 C,200,202,199,81,-1,1
Cool Gray 4 C,187,187,187,76,0,0
Cool Gray 5 C,177,180,179,73,-1,0
Cool Gray 6 C,165,169,172,69,-1,-2
Cool Gray 7 C,149,153,156,63,-1,-2
Cool Gray 8 C,136,140,143,58,-1,-2
Cool Gray 9 C,115,120,124,50,-1,-3
Cool Gray 10 C,95,103,106,43,-2,-3
Cool Gray 11 C,81,88,92,37,-2,-3
Green C,0,170,132,62,-47,9
Orange 021 C,255,83,2,60,64,70
Process Blue C,0,134,201,52,-12,-45
Purple C,179,49,184,46,67,-44
Red 032 C,243,54,65,54,70,40
Reflex Blue C,0,29,138,16,34,-66
Rhodamine Red C,223,21,152,50,78,-18
Rubine Red C,208,16,88,45,70,13
Violet C,40,19,153,21,49,-67
Warm Gray 1 C,218,211,205,85,1,4
Warm Gray 2 C,202,195,186,79,1,5
Warm Gray 3 C,191,184,176,75,1,5
Warm Gray 4 C,180,173,165,71,1,5
Warm Gray 5 C,172,165,157,68,1,5
Warm Gray 6 C,165,156,149,65,2,5
Warm Gray 7 C,150,140,132,59,2,6
Warm Gray 8 C,141,130,121,55,3,6
Warm Gray 9 C,130,120,110,51,2,7
Warm Gray 10 C,120,110,100,47,2,7
Warm Gray 11 C,109,97,88,42,3,7
Warm Red C,251,68,57,57,68,48
Yellow 012 C,255,213,16,87,2,86
Yellow C,255,220,21,89,-1,87
"""
